"""URL filtering by rules and, where no rule fits, by a tree of path templates.

Every host has a tree of its paths' segments, and a tree over all hosts stands behind it. Segments with digits are
wildcards from the start (their file type stays). From the root down, a branching with many different segments of few
pages each becomes one wildcard too. Pages that a rule judges label the nodes they pass. Down a page's chain of nodes, the
tree over all hosts first and the host's own then, a node whose share of blocked pages does not differ from the share so
far in a test of proportions merges with what is above it; one that differs puts its own smoothed share in its place.
What stands at the end is the template's impurity, and a template beyond one half is rejected.

All tables are of templates and nodes, with counts that are summed before a shuffle; pages meet their template in a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kmerweave.llm.common import cut_lineage, fresh, shuffles_end_with_jobs

#: Segments of a path that have a level of their own; what follows is one more segment.
DEPTH = 6
#: A branching is a wildcard with at least so many different segments, and fewer pages each than that.
MIN_SEGMENTS, FEW_PAGES = 10, 3
#: Weight of what stands above against one labelled page, and the least squared z-score of a difference.
SMOOTHING, DIFFERS = 4.0, 3.84

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HOST, _PATH = r"^(?s:.*?)://([^/?#]*)", r"^(?s:.*?)://[^/?#]*([^?#]*)"


def host_of(url) -> Column:
    """Empty for null and for anything without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url) -> Column:
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def _ordered(rules: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return sorted(rules, key=lambda r: (-len(r[1]), r[1]))


def matching_rule(rules: list[tuple[str, str]], host: Column, path: Column) -> Column:
    """The longest of the rules ``(verdict, host and path)`` that fits, as a struct; null if none does."""
    def one(verdict, rule):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        return F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))

    return F.coalesce(*[one(*r) for r in _ordered(rules)])


def _form(path: Column) -> Column:
    """Segments of a path, those with digits as wildcards, those beyond ``DEPTH`` as one."""
    segments = F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(path, "^/", ""), "/"))
    wild = F.transform(segments, lambda s: F.when(
        s.rlike("[0-9]"), F.concat(F.lit("*"), F.regexp_extract(s, r"(\.[A-Za-z]+)$", 1))).otherwise(s))
    return F.when(F.size(wild) > DEPTH, F.concat(F.slice(wild, 1, DEPTH), F.array(F.lit("**")))).otherwise(wild)


def _generalised(forms: DataFrame) -> DataFrame:
    """Adds each form's ``template``, level by level from the root."""
    grown = forms.withColumn("template", F.array().cast("array<string>"))
    for level in range(DEPTH):
        here = F.get("form", F.lit(level))
        branchings = grown.where(F.size("form") > level).groupBy("host", "template").agg(
            F.count_distinct(here).alias("segments"), F.sum("pages").alias("passing"))
        wild = (F.col("segments") >= MIN_SEGMENTS) & (F.col("passing") < FEW_PAGES * F.col("segments"))
        branchings = branchings.select("host", "template", wild.alias("wild"))
        segment = F.when(F.col("wild"), F.lit("*")).otherwise(here)
        grown = grown.join(branchings, ["host", "template"], "left").withColumn(
            "template", F.when(F.size("form") > level, F.concat("template", F.array(segment))).otherwise(
                F.col("template"))).drop("wild")
    return grown.withColumn("template", F.when(F.size("form") > DEPTH, F.concat(
        "template", F.array(F.lit("**")))).otherwise(F.col("template")))


def _nodes(scope: Column, base: int) -> Column:
    """Nodes of a tree that a template passes, the root first."""
    return F.transform(F.sequence(F.lit(0), F.size("template")), lambda k: F.struct(
        scope.alias("scope"), (k + base).alias("step"), F.slice("template", F.lit(1), k).alias("prefix")))


def _impurity(chain: Column) -> Column:
    """Share of blocked pages at the end of a chain of nodes ``(step, allow, block)`` from the root down."""
    def step(share, node):
        n = node["allow"] + node["block"]
        gap = node["block"] - n * share
        differs = gap * gap > DIFFERS * n * share * (1 - share)
        return F.when((n > 0) & differs, (node["block"] + SMOOTHING * share) / (n + SMOOTHING)).otherwise(share)

    return F.aggregate(F.sort_array(chain), F.lit(0.5), step)


def judge(pages: DataFrame, rules: list[tuple[str, str]], url_col="url", out_col="judged") -> DataFrame:
    """``pages`` with the struct ``out_col`` (in place of a column of that name): ``host``, ``path``, ``rule`` (null if
    none fits), ``verdict`` (the rule's, else the template's) and ``impurity``, the template's share of blocked pages.

    A null URL, or one without ``://``, has an empty host and path. Repeated rows count as often as they occur. Without
    any labelled page the share is one half and all is allowed.
    """
    row, parts = fresh(pages, "row"), fresh(pages, out_col + "_")
    host, path = host_of(pages[url_col]), path_of(pages[url_col])
    rows = pages.select(F.struct(*[pages[c] for c in pages.columns]).alias(row), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("found", matching_rule(rules, F.col("host"), F.col("path"))).withColumn(
        "form", _form(F.col("path")))
    count = lambda verdict: F.sum((F.col("found.verdict") == verdict).cast("long"))
    with shuffles_end_with_jobs(pages.sparkSession):
        forms = cut_lineage(rows.groupBy("host", "form").agg(
            F.count(F.lit(1)).alias("pages"), F.coalesce(count("allow"), F.lit(0)).alias("allow"),
            F.coalesce(count("block"), F.lit(0)).alias("block")), "url-forms")
        templates = cut_lineage(_generalised(forms), "url-templates")
        chains = templates.select("host", "form", "allow", "block", F.explode(F.concat(
            _nodes(F.lit("*"), 0), _nodes(F.concat(F.lit("."), "host"), DEPTH + 2))).alias("node")).select(
            "host", "form", "allow", "block", "node.*")
        nodes = cut_lineage(chains.groupBy("scope", "step", "prefix").agg(
            F.sum("allow").alias("allow"), F.sum("block").alias("block")), "url-nodes")
        impure = cut_lineage(chains.drop("allow", "block").join(nodes, ["scope", "step", "prefix"]).groupBy(
            "host", "form").agg(F.collect_list(F.struct("step", "allow", "block")).alias("chain")).select(
            "host", "form", _impurity(F.col("chain")).alias("impurity")), "url-impurity")
    verdict = F.coalesce("found.verdict", F.when(F.col("impurity") > 0.5, "block").otherwise("allow"))
    judged = F.struct("host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "impurity")
    others = [F.col(f"{row}.`{c}`") for c in pages.columns if c != out_col]
    return rows.join(impure, ["host", "form"]).select(row, judged.alias(parts)).select(
        *others, F.col(parts).alias(out_col))


def sql(rules: list[tuple[str, str]]) -> str:
    """The same in DuckDB's SQL, over ``pages``: ``page_id, host, path, rule, verdict``."""
    def fits(rule):
        domain, slash, rest = rule.partition("/")
        return f"((host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{slash}{rest}'))"

    def cases(value):
        return "CASE " + " ".join(f"WHEN {fits(r[1])} THEN '{value(r)}'" for r in _ordered(rules)) + " END"

    levels = []
    for k in range(DEPTH):
        levels.append(f"""
branch{k} AS (
  SELECT host, template, count(DISTINCT form[{k + 1}]) >= {MIN_SEGMENTS}
         AND sum(pages) < {FEW_PAGES} * count(DISTINCT form[{k + 1}]) AS wild
  FROM grown{k} WHERE len(form) > {k} GROUP BY host, template),
grown{k + 1} AS (
  SELECT host, form, pages, allow, block, CASE WHEN len(form) > {k}
         THEN list_append(template, CASE WHEN wild THEN '*' ELSE form[{k + 1}] END) ELSE template END AS template
  FROM grown{k} LEFT JOIN branch{k} USING (host, template)),""")
    return f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '{_HOST}', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
         coalesce(regexp_extract(url, '{_PATH}', 1), '') AS path
  FROM pages),
segmented AS (
  SELECT *, {cases(lambda r: r[1])} AS rule, {cases(lambda r: r[0])} AS ruled,
         CASE WHEN path = '' THEN CAST([] AS VARCHAR[]) ELSE list_transform(
           string_split(regexp_replace(path, '^/', ''), '/'),
           lambda s: CASE WHEN regexp_matches(s, '[0-9]') THEN '*' || regexp_extract(s, '(\\.[A-Za-z]+)$', 1) ELSE s END)
         END AS wild_form
  FROM parts),
formed AS (
  SELECT *, CASE WHEN len(wild_form) > {DEPTH} THEN list_append(wild_form[1:{DEPTH}], '**') ELSE wild_form END AS form
  FROM segmented),
grown0 AS (
  SELECT host, form, count(*) AS pages, count(*) FILTER (ruled = 'allow') AS allow,
         count(*) FILTER (ruled = 'block') AS block, CAST([] AS VARCHAR[]) AS template
  FROM formed GROUP BY host, form),{"".join(levels)}
templates AS (
  SELECT host, form, allow, block,
         CASE WHEN len(form) > {DEPTH} THEN list_append(template, '**') ELSE template END AS template
  FROM grown{DEPTH}),
chains AS (
  SELECT host, form, allow, block, '*' AS scope, k AS step, template[1:k] AS prefix
  FROM templates, unnest(range(len(template) + 1)) AS u(k)
  UNION ALL
  SELECT host, form, allow, block, '.' || host, k + {DEPTH + 2}, template[1:k]
  FROM templates, unnest(range(len(template) + 1)) AS u(k)),
nodes AS (
  SELECT scope, step, prefix, CAST(sum(allow) AS DOUBLE) AS allow, CAST(sum(block) AS DOUBLE) AS block
  FROM chains GROUP BY scope, step, prefix),
impure AS (
  SELECT host, form, list_reduce(
    list_prepend({{'a': 0.0::DOUBLE, 'b': 0.0::DOUBLE, 's': 0.5::DOUBLE}},
                 list({{'a': n.allow, 'b': n.block, 's': 0.0::DOUBLE}} ORDER BY step)),
    lambda x, y: {{'a': y.a, 'b': y.b, 's': CASE
      WHEN y.a + y.b > 0 AND (y.b - (y.a + y.b) * x.s) * (y.b - (y.a + y.b) * x.s)
           > {DIFFERS} * (y.a + y.b) * x.s * (1 - x.s)
      THEN (y.b + {SMOOTHING} * x.s) / (y.a + y.b + {SMOOTHING}) ELSE x.s END}}).s AS impurity
  FROM chains JOIN nodes n USING (scope, step, prefix) GROUP BY host, form)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN impurity > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM formed JOIN impure USING (host, form)
"""
