"""Document fingerprints: one-permutation MinHash with optimal densification, packed to a few bits a bin.

DataFrame functions only.

1. *Shingles*: texts are lower-cased and cut at ASCII white space; every five words
   in a row are one 64-bit hash (a text of fewer words is one shingle of them all).
2. *One permutation*: a hash's first byte is its bin, one of 256, and a bin keeps its
   least hash. An end mark for each bin is sorted in with the hashes; the first entry
   of each bin is then its least hash, or the mark of an empty bin.
3. *Densification*: an empty bin takes the hash of another one, by a probe order of its
   own that does not depend on the text: ``ATTEMPTS`` random bins in turn, and after
   those the full bin that comes first in a random order of all bins. Two texts of
   likeness J so agree in an empty bin with probability J, as they do in a full one.
4. *Packing*: of each bin ``BITS`` low bits of the hash, mixed with the bin's number,
   are kept, 16 bins to a BIGINT. Bins of unlike texts agree by chance with
   probability ``2 ** -BITS``; ``likeness`` corrects for that.

The likeness of two fingerprints estimates the Jaccard likeness of the two sets of
shingles with a standard error of at most 0.034 (0.5 / sqrt(256) / (1 - 1/16)).

Defined cases: NULL counts as the empty text; texts without words have one and the
same fingerprint, which is like no other; equal texts have equal fingerprints;
repeated rows get the same result each; an empty table gives no rows; extra columns
pass through, except one with the output's name, which the result replaces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promoscope.llm.common import Scratch
from promoscope.operators.ranking import global_rank

WORDS, BITS, ATTEMPTS = 5, 4, 16
BIN_BITS = 8
BINS = 1 << BIN_BITS
_LOW = 64 - BIN_BITS                    # bits of a hash below its bin
_MARK = (1 << _LOW) - 1                 # these bits all set: the end mark of a bin
_A_WORD = 64 // BITS                    # bins packed into a BIGINT
_SPACE = " \t\n\x0b\x0c\r"
_FIRST_OF_EACH = sum(1 << (BITS * k) for k in range(_A_WORD))      # the lowest bit of every bin of a BIGINT


def _long(value: int) -> Column:
    """``value``, given as 64 unsigned bits."""
    return F.lit(value - (1 << 64) if value >= 1 << 63 else value).cast("long")


def _bin(h: Column) -> Column:
    """A hash's bin, 0 to 255, rising with the (signed) hash."""
    return F.shiftright(h, _LOW).cast("int") + F.lit(BINS // 2)


def _words(text: Column) -> Column:
    plain = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(_SPACE))
    return F.split(plain, r"[\x20\x09-\x0D]+")


def _shingles(words: Column, after: Column | int = 0) -> Column:
    """Hashes of the runs of words that begin ``after`` so many words (an array of one or more)."""
    after = F.lit(after) if isinstance(after, int) else after
    runs = F.greatest(F.size(words) - (WORDS - 1), F.lit(1)) - after
    return F.transform(F.slice(words, after + 1, runs), lambda w, i: F.xxhash64(w, *[F.get(words, i + after + k) for k in range(1, WORDS)]))


def _packed(rows: DataFrame, columns: list[Column], hashes: str, name: str) -> DataFrame:
    """``columns`` of ``rows`` and the fingerprint of the shingles in the column ``hashes``."""
    tag = f"_fp{uuid.uuid4().hex[:8]}_"
    ordered, dense, bits = (F.col(tag + c) for c in ("ordered", "dense", "bits"))
    marks = F.array(*[_long(((b - BINS // 2) % BINS << _LOW) | _MARK) for b in range(BINS)])
    step = rows.withColumn(tag + "ordered", F.sort_array(F.concat(F.col(hashes), marks)))
    # the entries that follow a mark, or nothing, are the first of their bins; a mark there is an empty bin
    mark = _long(_MARK)
    before = F.concat(F.array(mark), F.slice(ordered, 1, F.size(ordered) - 1))
    first = F.filter(F.zip_with(ordered, before, lambda h, p: F.when(p.bitwiseAND(mark) == mark, h)), lambda h: h.isNotNull())
    step = step.withColumn(tag + "dense", F.transform(first, lambda h: F.when(h.bitwiseAND(mark) != mark, h)))

    def filled(h: Column, i: Column) -> Column:
        probes = [F.get(dense, F.pmod(F.xxhash64(i, F.lit(k)), F.lit(BINS)).cast("int")) for k in range(ATTEMPTS)]
        full = F.filter(dense, lambda x: x.isNotNull())
        rest = F.array_min(F.transform(full, lambda x: F.struct(F.xxhash64(i, _bin(x)).alias("place"), x.alias("hash"))))
        return F.coalesce(h, *probes, rest["hash"])

    mixed = F.transform(dense, lambda h, i: F.xxhash64(filled(h, i), i).bitwiseAND(F.lit((1 << BITS) - 1).cast("long")))
    step = step.withColumn(tag + "bits", mixed)
    # word by word, not in one lambda: the optimiser would move ``bits`` into it and compute it for every word
    packed = F.array(*[F.aggregate(F.slice(bits, w + 1, _A_WORD), F.lit(0).cast("long"), lambda got, x: F.shiftleft(got, BITS).bitwiseOR(x))
                       for w in range(0, BINS, _A_WORD)])
    return step.select(*columns, packed.alias(name))


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the text's fingerprint, an array of 16 BIGINTs."""
    tag = f"_fp{uuid.uuid4().hex[:8]}_"
    columns = [F.col(f"`{c}`") for c in docs.columns if c != name]
    step = docs.select("*", _words(F.col(f"`{text}`")).alias(tag + "words"))
    step = step.withColumn(tag + "hashes", _shingles(F.col(tag + "words")))
    return _packed(step, columns, tag + "hashes", name)


def _with_both(rows: DataFrame, text: str, edited: str) -> DataFrame:
    """``rows`` with ``fingerprint`` and ``edited_fingerprint`` in place of a text and its edited form: the runs of
    words that lie within the words both begin with are hashed once."""
    columns = [F.col(c) for c in rows.columns if c not in (text, edited)]
    wa, wb, ha = F.col("words_a"), F.col("words_b"), F.col("hashes_a")
    step = rows.select(*columns, _words(F.col(text)).alias("words_a"), _words(F.col(edited)).alias("words_b"))
    step = step.withColumn("hashes_a", _shingles(wa))
    most = F.least(F.size(wa), F.size(wb))
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    begin = F.aggregate(steps, F.lit(0), lambda got, s: F.when(
        (got <= most - s) & (F.slice(wa, got + 1, s) == F.slice(wb, got + 1, s)), got + s).otherwise(got))
    # a run must lie within the common words, and one run at least is left to the end of the edited text
    step = step.withColumn("same", F.greatest(F.least(begin, F.size(wb) - 1) - (WORDS - 1), F.lit(0)))
    step = step.withColumn("hashes_b", F.concat(F.slice(ha, F.lit(1), F.col("same")), _shingles(wb, F.col("same"))))
    step = _packed(step, [*columns, F.col("hashes_b")], "hashes_a", "fingerprint")
    return _packed(step, [*columns, F.col("fingerprint")], "hashes_b", "edited_fingerprint")


def as_text(fingerprint: Column) -> Column:
    """The fingerprint as hexadecimal digits, one for each bin."""
    return F.array_join(F.transform(fingerprint, lambda w: F.lpad(F.hex(w), 16, "0")), "")


def from_text(digits: Column) -> Column:
    """``as_text`` undone."""
    return F.transform(F.sequence(F.lit(0), F.lit(BINS // _A_WORD - 1)),
                       lambda w: F.conv(F.substring(digits, w * 16 + 1, F.lit(16)), 16, -10).cast("long"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness (0 to 1) of the texts of two fingerprints: the share of bins that agree, less
    those that agree by chance."""
    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        any_bit = z
        for k in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(z, k))
        return F.bit_count(any_bit.bitwiseAND(_long(_FIRST_OF_EACH)))

    differ = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda got, n: got + n)
    chance = 2.0 ** -BITS
    return F.greatest((1 - differ / F.lit(float(BINS)) - F.lit(chance)) / F.lit(1 - chance), F.lit(0.0))


def edited_by_next(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every document beside the next one by descending key, and beside an edited text: the last third of its
    characters (rounded down) replaced by the first as many of the next document, or all of them. After the last
    document comes the first.

    Columns: the key, ``n_chars``, ``fingerprint``, ``next_key``, ``next_fingerprint``, ``edited_sha256`` and
    ``edited_fingerprint``. Keys in no order (equal, NULL: last) are ordered by a hash of the row; rows with the same
    key and text are one document and get the same result each.

    The order is worked out on narrow rows (ranges and offsets, no window over the whole table). The texts are
    shuffled once, and once more the characters that a neighbour asks for; both fingerprints of a document are then
    made and written, and the neighbours' fingerprints met by a join of narrow rows."""
    scratch = Scratch(docs.sparkSession, "fingerprints")
    base = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    base = base.select("key", "text", *[F.xxhash64(F.lit(k), F.col("key").isNull(), F.col("key").cast("string"), F.col("text")).alias(f"h{k}")
                                        for k in (1, 2)])
    ids = base.select("key", "h1", "h2", F.char_length("text").cast("long").alias("n")).distinct()
    ranked = scratch.write(global_rank(ids, ["key", "h1", "h2"], "place", "row_number", descending=[True, False, False], one_task_rows=0), "places")
    total = ranked.count()
    asks = ranked.select((F.col("place") % F.lit(max(total, 1)) + 1).alias("place"), F.col("h1").alias("to1"), F.col("h2").alias("to2"),
                         F.floor(F.col("n") / 3).cast("int").alias("need"))
    links = scratch.write(ranked.join(asks, "place").select("h1", "h2", "to1", "to2", "need"), "links")

    # one giver for each asker: equal rows are one document. Both sides need the same columns, so that the texts are
    # shuffled once for both
    given = (base.join(links, ["h1", "h2"])
             .withColumn("copy", F.expr("row_number() OVER (PARTITION BY h1, h2 ORDER BY h1)")).filter("copy = 1")
             .select(F.col("to1").alias("h1"), F.col("to2").alias("h2"), F.col("key").alias("next_key"),
                     F.left("text", F.col("need")).alias("given")))
    n = F.char_length("text")
    edited = base.join(given, ["h1", "h2"]).select(
        "key", "h1", "h2", "text", n.cast("long").alias("n_chars"), "next_key",
        F.concat(F.left("text", n - F.floor(n / 3).cast("int")), F.col("given")).alias("edited"))
    made = edited.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    made = scratch.write(_with_both(made, "text", "edited"), "made")
    first = made.groupBy("h1", "h2").agg(F.first("fingerprint").alias("next_fingerprint"))
    theirs = links.join(first, ["h1", "h2"]).select(F.col("to1").alias("h1"), F.col("to2").alias("h2"), "next_fingerprint")
    return (made.join(theirs, ["h1", "h2"])
            .select(F.col("key").alias(key), "n_chars", "fingerprint", "next_key", "next_fingerprint", "edited_sha256", "edited_fingerprint"))
