"""Alphabets of equal-length letters and the string expressions they imply."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The digit characters that ``conv`` understands, in order.
DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


class Alphabet:
    """An ordered set of letters, all of one length (one character or more).

    The object itself is a tiny driver-side value; its methods build Spark
    expressions over sequence columns.
    """

    def __init__(self, letters):
        letters = tuple(letters)
        lengths = {len(x) for x in letters}
        if len(lengths) != 1 or 0 in lengths:
            raise ValueError("all letters of an alphabet must have the same positive length")
        if len(set(letters)) != len(letters):
            raise ValueError("letters of an alphabet must be distinct")
        self.letters = letters
        self.letter_len = lengths.pop()

    def __len__(self):
        return len(self.letters)

    def __eq__(self, other):
        return isinstance(other, Alphabet) and self.letters == other.letters

    def __hash__(self):
        return hash(self.letters)

    def __getitem__(self, index):
        return self.letters[index]

    def __repr__(self):
        return f"Alphabet({list(self.letters)!r})"

    @property
    def single_char(self):
        return self.letter_len == 1

    # -- sequence -> parts -------------------------------------------------

    def length(self, seq) -> Column:
        """Number of letters in a sequence column."""
        chars = F.length(seq)
        return chars if self.single_char else (chars / self.letter_len).cast("int")

    def checked(self, seq) -> Column:
        """The sequence itself; the job fails where it is not a whole number of
        known letters."""
        seq = _col(seq)
        if self.single_char:
            ok = F.length(F.translate(seq, "".join(self.letters), "")) == 0
        else:
            table = F.array(*[F.lit(x) for x in self.letters])
            ok = (F.length(seq) % self.letter_len == 0) & F.forall(
                self.tokens(seq), lambda x: F.array_contains(table, x))
        return F.when(ok, seq).otherwise(
            F.raise_error(F.concat(F.lit("not a sequence over the alphabet: "), seq)))

    def tokens(self, seq) -> Column:
        """``array<string>`` of letters, cut in one linear pass."""
        return F.regexp_extract_all(
            _col(seq), F.lit("(?s)(.{%d})" % self.letter_len), F.lit(1))

    def indices(self, seq) -> Column:
        """``array<int>`` of letter indices; unknown letters fail the job."""
        table = F.array(*[F.lit(x) for x in self.letters])
        return F.transform(
            self.tokens(self.checked(seq)),
            lambda x: (F.array_position(table, x) - 1).cast("int"))

    def letter_index(self, letter) -> Column:
        """Index of one letter; unknown letters fail the job."""
        letter = _col(letter)
        table = F.array(*[F.lit(x) for x in self.letters])
        at = F.array_position(table, letter)
        return F.when(at > 0, (at - 1).cast("int")).otherwise(
            F.raise_error(F.concat(F.lit("unknown letter: "), letter)).cast("int"))

    def from_indices(self, indices) -> Column:
        """Sequence string of an ``array<int>`` of letter indices."""
        table = F.array(*[F.lit(x) for x in self.letters])
        return F.array_join(
            F.transform(_col(indices), lambda i: F.element_at(table, i + 1)), "")

    def digits(self, seq) -> Column:
        """The sequence with each letter replaced by its base-``n`` digit."""
        if len(self) > len(DIGITS):
            raise ValueError("at most 36 letters can be encoded as digits")
        if self.single_char:
            return F.translate(_col(seq), "".join(self.letters), DIGITS[:len(self)])
        return F.array_join(
            F.transform(self.indices(seq), lambda i: F.substring(F.lit(DIGITS), i + 1, F.lit(1))), "")

    # -- sequence -> sequence ----------------------------------------------

    def _letter(self, x):
        return self.letters[x] if isinstance(x, int) else x

    def substitute(self, seq, mapping) -> Column:
        """Replaces letters. A dict maps one way; a list of pairs maps both
        ways. Entries may be letters or letter indices."""
        if isinstance(mapping, dict):
            table = {self._letter(k): self._letter(v) for k, v in mapping.items()}
        else:
            table = {}
            for x, y in mapping:
                x, y = self._letter(x), self._letter(y)
                table[x], table[y] = y, x
        unknown = [x for pair in table.items() for x in pair if x not in self.letters]
        if unknown:
            raise KeyError(f"not in the alphabet: {unknown}")
        if self.single_char:
            return F.translate(_col(seq), "".join(table), "".join(table.values()))
        lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
        return F.array_join(
            F.transform(self.tokens(seq), lambda x: F.coalesce(F.element_at(lookup, x), x)), "")

    def reverse(self, seq) -> Column:
        """Reverses the order of letters (not of characters)."""
        if self.single_char:
            return F.reverse(_col(seq))
        return F.array_join(F.reverse(self.tokens(seq)), "")

    def reverse_complement(self, seq, pairs=(("A", "T"), ("C", "G"))) -> Column:
        return self.reverse(self.substitute(seq, list(pairs)))

    def slice(self, seq, start, stop) -> Column:
        """Letters ``start..stop-1`` (0-based)."""
        n = self.letter_len
        return F.substring(_col(seq), _lit(start) * n + 1, (_lit(stop) - _lit(start)) * n)

    def letter_at(self, seq, index) -> Column:
        """Index of the letter at a 0-based position."""
        return self.letter_index(self.slice(seq, index, _lit(index) + 1))


def content_id(seq) -> Column:
    """Content identity of a sequence: the hex SHA-1 of its string."""
    return F.sha1(_col(seq).cast("binary"))


def same_sequence(a, b) -> Column:
    return content_id(a) == content_id(b)


def sequence_columns(seqs, alphabet: Alphabet):
    """Adds ``content_id`` and ``len`` to a table with a ``seq`` column."""
    return seqs.withColumn("content_id", content_id("seq")).withColumn(
        "len", alphabet.length("seq"))


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


DNA = Alphabet("ACGT")
DNA_LOWER = Alphabet("acgt")
