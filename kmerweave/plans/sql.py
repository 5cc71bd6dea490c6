"""Plain-SQL statements of the catalogue's queries, built from shared CTEs."""

from __future__ import annotations

from kmerweave.functions import stats


def dbl(x) -> str:
    """Literal that SQL parses as a double."""
    text = repr(float(x))
    return text if "e" in text else text + "e0"


def letters(text):
    return f"regexp_replace(lower({text}), '[^acgt]', '', 'g')"


DOCS = f"docs AS (SELECT doc_id AS seq_id, {letters('text')} AS seq FROM documents)"
BENCH = f"bench AS (SELECT item_id AS seq_id, {letters('text')} AS seq FROM benchmark)"
PAGES = f"pgs AS (SELECT page_id AS seq_id, {letters('html')} AS seq FROM pages)"
TURNS = f"turns AS (SELECT conv_id AS group_id, turn AS ord, {letters('text')} AS seq FROM conversations)"


def word_value(word, w):
    return " + ".join(
        f"(strpos('acgt', substr({word}, {k + 1}, 1)) - 1) * {4 ** (w - 1 - k)}" for k in range(w))


def words(name, source, w, ids="seq_id"):
    return f"""{name} AS (
  SELECT {ids}, pos, CAST({word_value('word', w)} AS BIGINT) AS kmer FROM (
    SELECT {ids}, p AS pos, substr(seq, p + 1, {w}) AS word FROM (
      SELECT {ids}, seq, unnest(range(0, length(seq) - {w} + 1)) AS p
      FROM {source} WHERE length(seq) >= {w})))"""


def seeds(s_words, t_words, extra=""):
    return f"""seeds AS MATERIALIZED (
  SELECT s.seq_id AS s_id, t.seq_id AS t_id, s.kmer, s.pos AS i, t.pos AS j,
         s.pos - t.pos AS d, s.pos + t.pos AS a
  FROM {s_words} s JOIN {t_words} t ON s.kmer = t.kmer {extra})"""


def doc_seeds(w):
    """Seeds of benchmark items (s) against documents (t)."""
    return ",\n".join([DOCS, BENCH, words("bk", "bench", w), words("dk", "docs", w), seeds("bk", "dk")])


def select(ctes, body, recursive=False):
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"


# -- statistics --------------------------------------------------------------

def variance(p, pw, w):
    return f"((1 - {pw}) * ({pw} + 2 * {p} * {pw} / (1 - {p})) - {2 * w} * {pw} * {pw})"


def h0(n_letters, w, area):
    mean, var = stats.null_constants(n_letters, w)
    return f"(({area}) * {dbl(mean)})", f"sqrt(({area}) * {dbl(var)})"


def h1(n_letters, w, area, length, p):
    mean, var = stats.null_constants(n_letters, w)
    q = f"(CASE WHEN {p} = 1 THEN {dbl(1 - stats.MACHINE_EPS)} ELSE {p} END)"
    pw = f"pow({q}, {w})"
    return (f"(({area}) * {dbl(mean)} + ({length}) * {pw})",
            f"sqrt(({area}) * {dbl(var)} + ({length}) * {variance(q, pw, w)})")


def z_scores(n, area, length, p, n_letters, w):
    none = "CAST('-inf' AS DOUBLE)"
    out = []
    for mu, sd in (h0(n_letters, w, area), h1(n_letters, w, area, length, p)):
        out.append(f"CASE WHEN ({area}) = 0 THEN {none} ELSE ({n} - {mu}) / nullif({sd}, 0) END")
    return out


def root(word_p, w):
    return (f"CASE WHEN ({word_p}) > 0 THEN least(1e0, exp(ln(greatest({word_p}, 1e-300)) / {w})) "
            f"ELSE 0e0 END")


def match_p(n, area, length, n_letters, w):
    mean, _ = stats.null_constants(n_letters, w)
    return root(f"(({n}) - ({area}) * {dbl(mean)}) / ({length})", w)


def r6(x):
    return f"round({x}, 6) + 0e0"


# -- scored seeds and segments -----------------------------------------------

def scored(source, k, r, w, n_letters=4):
    """Neighbours are counted along each diagonal, on which every seed within reach of it is repeated."""
    return f"""reached AS (
  SELECT s_id, t_id, i, j, d, a, true AS own FROM {source}
  UNION ALL SELECT s_id, t_id, i, j, d + unnest(range(-{r}, {r} + 1)), a, false FROM {source}),
boxed AS (
  SELECT s_id, t_id, i, j, n - 1 AS n_neigh FROM (
    SELECT *, count(*) FILTER (WHERE NOT own) OVER (PARTITION BY s_id, t_id, d ORDER BY a
      RANGE BETWEEN {k} PRECEDING AND {k} FOLLOWING) AS n FROM reached) WHERE own),
scored AS (
  SELECT {source}.*, n_neigh, {match_p('n_neigh + 1', 2 * r * k, k, n_letters, w)} AS p
  FROM {source} JOIN boxed USING (s_id, t_id, i, j))"""


def segment_ctes(k, r, p_min, s_src, t_src, at_least_one=False, order="kmer, i, j", stored="seeds"):
    keep = f"WHERE p >= {dbl(p_min)}"
    if at_least_one:
        keep = (f"QUALIFY p >= {dbl(p_min)}"f" OR (max(p) OVER (PARTITION BY s_id, t_id) < {dbl(p_min)} AND "
                 f"row_number() OVER (PARTITION BY s_id, t_id ORDER BY p DESC, {order}) = 1)")
    return f"""good AS (
  SELECT *, row_number() OVER (ORDER BY s_id, t_id, {order}) AS id FROM (
    SELECT * FROM scored {keep})),
links AS (
  SELECT x.id AS u, y.id AS v FROM good x JOIN good y ON x.s_id = y.s_id AND x.t_id = y.t_id
    AND abs(x.d - y.d) <= {r} AND abs(x.a - y.a) <= {k} AND x.id <> y.id),
reach(id, label) AS (
  SELECT id, id FROM good
  UNION SELECT links.v, reach.label FROM reach JOIN links ON reach.id = links.u WHERE reach.label < links.v),
roots AS (SELECT id, min(label) AS root FROM reach GROUP BY id),
groups AS (
  SELECT s_id, t_id, root, min(d) - {r} AS d_min, max(d) + {r} AS d_max, min(a) - {k} AS a_min,
         max(a) + {k} AS a_max, (sum(p) + min_by(p, id)) / (count(*) + 1) AS p,
         count(*) AS n_qualified FROM good JOIN roots USING (id) GROUP BY s_id, t_id, root),
boxes AS (
  SELECT s_id, t_id, root, least(length(s.seq), greatest(d_min, -length(t.seq))) AS d_min,
         least(length(s.seq), greatest(d_max, -length(t.seq))) AS d_max,
         greatest(a_min, 0) AS a_min, least(a_max, length(s.seq) + length(t.seq)) AS a_max, p, n_qualified
  FROM groups JOIN {s_src} s ON s.seq_id = s_id JOIN {t_src} t ON t.seq_id = t_id),
counted AS (
  SELECT b.*, (SELECT count(*) FROM {stored} z WHERE z.s_id = b.s_id AND z.t_id = b.t_id
               AND z.d BETWEEN b.d_min AND b.d_max AND z.a BETWEEN b.a_min AND b.a_max) AS n_seeds,
         (a_max - a_min) // 2 AS k_hat, (d_max - d_min) * ((a_max - a_min) // 2) AS area
  FROM boxes b)"""


def segment_rows(w, n_letters=4):
    z0, z1 = z_scores("n_seeds", "area", "k_hat", "p", n_letters, w)
    return f"""SELECT s_id, t_id, CAST(d_min AS BIGINT) AS d_min, CAST(d_max AS BIGINT) AS d_max,
  CAST(a_min AS BIGINT) AS a_min, CAST(a_max AS BIGINT) AS a_max, {r6('p')} AS p,
  CAST(n_qualified AS BIGINT) AS n_qualified, CAST(n_seeds AS BIGINT) AS n_seeds,
  round({z0}, 3) + 0e0 AS z_h0, round({z1}, 3) + 0e0 AS z_h1 FROM counted"""


# -- overlaps ----------------------------------------------------------------

def overlap_ctes(w, g, sens, s_src, t_src, source="seeds", order="kmer, i, j", n_letters=4):
    c = stats.band_constant(g, sens)
    return f"""hist AS (
  SELECT s_id, t_id, d, count(*) AS n, min(({order})) AS first FROM
    (SELECT s_id, t_id, d, kmer, i, j FROM {source}) GROUP BY s_id, t_id, d),
dims AS (
  SELECT *, CAST(greatest(1, ceil({dbl(c)} * sqrt(len))) AS BIGINT) AS r FROM (
    SELECT hist.*, CAST(ceil({dbl(2 / (2 - g))} *
      (least(length(s.seq) - d, length(t.seq)) + least(d, 0))) AS BIGINT) AS len
    FROM hist JOIN {s_src} s ON s.seq_id = s_id JOIN {t_src} t ON t.seq_id = t_id)),
near AS (
  SELECT *, sum(n) OVER (PARTITION BY s_id, t_id ORDER BY d / CAST(r AS DOUBLE)
    RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n_band FROM dims),
diagonals AS (SELECT *, {match_p('n_band', '2 * r * len', 'len', n_letters, w)} AS p FROM near),
best AS (
  SELECT s_id, t_id, d - r AS d_lo, d + r AS d_hi, p, len, r FROM diagonals
  QUALIFY row_number() OVER (PARTITION BY s_id, t_id ORDER BY p DESC, first) = 1),
banded AS (
  SELECT best.*, (SELECT sum(n) FROM hist h WHERE h.s_id = best.s_id AND h.t_id = best.t_id
                  AND h.d BETWEEN d_lo AND d_hi) AS n_seeds FROM best)"""


def overlap_rows(w, n_letters=4):
    mu, sd = h1(n_letters, w, "2 * r * len", "len", "p")
    return f"""SELECT s_id, t_id, CAST(d_lo AS BIGINT) AS d_lo, CAST(d_hi AS BIGINT) AS d_hi, {r6('p')} AS p,
  CAST(len AS BIGINT) AS len, CAST(n_seeds AS BIGINT) AS n_seeds,
  {r6(f'(n_seeds - {mu}) / nullif({sd}, 0)')} AS score FROM banded"""
