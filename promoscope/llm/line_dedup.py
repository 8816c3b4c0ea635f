"""Line dedup: segment-partition edit join with banded bit-parallel verification.

Main path: DataFrame functions only.

A line goes when an equal line, or one within the pair's edit budget, occurs earlier
(by key, then line number). The budget of two lines is that of the longer one: 2 edits
from 20 characters on, 1 edit from 10 on, none below (``BUDGETS``), whichever of the
two came first. Blank lines always stay.

1. *Equal lines* are grouped by a 128-bit hash; each group's first place is kept.
2. *Segments*: for a budget of k a line is cut into k + 1 segments; k edits leave one
   of them untouched, so a similar line holds it. Each line looks up, for every length
   from its own down to k less, the substrings that can be a segment there: with s
   edits to the left of a segment it is shifted by s at most, and the length difference
   bounds the shift from the right (12 look-ups for two edits, 4 for one). A line a
   little too short for a budget is also found by the segments of that budget. A key is
   the hash of budget, segment number, length and substring.
3. Only keys met by two different lines go on; their lines' texts are fetched, and
   a semi-join asks whether an earlier line under the same key is within the
   budget. No pair is ever written out: a row stops at its first partner.
4. *Verification*: common prefix and suffix are trimmed, then a band of
   2 * TAU + 1 diagonals runs through the rest in one machine word per character.

Lines that make up 1/65536 of all lines or more (at most 65536 of them) enter the
look-up once instead of at each place, so no key is hot for copies of a line.

Defined cases: NULL text stays NULL with 0 lines; an empty text is one blank
line; a NULL key comes before all others; rows with the same key and text are one
document and get the same result; ties in key order go by a hash of the text;
extra columns pass through, except output names, which the result replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from promoscope.llm.common import Scratch

TAU = 2
BUDGETS = {1: 10, 2: 20}    # edits: characters of the longer line from which they are allowed
HOT_BITS = 16           # lines of at least this share (2 ** -16) are looked up once
RESIDUES = 1 << 20      # bound of the broadcast that thins out the texts to fetch


def _identity(text: str, key: str) -> Column:
    return F.xxhash64(F.col(key).cast("string"), F.lit("|"), F.col(text))


def _lines(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(doc, key, pos, line, h1, h2): the lines of all texts that are not blank."""
    return (docs.select(_identity(text, key).alias("doc"), F.col(key).alias("key"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
            .filter(F.trim("line") != "")
            .withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(7), "line")))


def _ask(k: int, less: int, i: int, shift: int) -> Column:
    """Look-up of segment ``i`` of a line of ``less`` characters fewer cut into ``k + 1`` segments, ``shift`` places to the right."""
    return F.struct(F.lit(k).alias("k"), F.lit(less).alias("less"), F.lit(i).alias("i"), F.lit(shift).alias("shift"))


def _asks(k: int) -> list[Column]:
    """A line's look-ups with a budget of ``k``, its own segments among them."""
    return [_ask(k, less, i, shift) for less in range(k + 1) for i in range(k + 1)
            for shift in range(max(-i, less - (k - i)), min(i, less + (k - i)) + 1)]


def _lookups(lines: DataFrame) -> DataFrame:
    """(segment, own, h1): the segment keys that the lines (h1, line, size) look up; are they of the line's own segments?

    A line's look-ups are rows before they are computed: written out side by side, their code is too long a method
    for the JVM to compile."""
    own = lambda k: [_ask(k, 0, i, 0) for i in range(k + 1)]
    two, one, size = BUDGETS[2], BUDGETS[1], F.col("size")
    asks = (F.when(size >= two, F.array(*_asks(2)))
            .when(size >= two - 2, F.array(*_asks(1), *own(2)))       # found by lines of two edits
            .when(size >= one, F.array(*_asks(1)))
            .when(size >= one - 1, F.array(*own(1))))
    rows = lines.select("h1", "line", "size", F.explode(asks).alias("ask")).select("h1", "line", "size", "ask.*")
    k, i, n = F.col("k"), F.col("i"), F.col("size") - F.col("less")
    part = F.floor(n / (k + 1)).cast("int")
    # the odd characters go to the middle one of three segments, or to the last of two
    start = F.when(i == 0, F.lit(0)).when(i == 1, part).otherwise(n - part)
    length = F.when(i == 1, n - k * part).otherwise(part)
    return rows.select(F.xxhash64(k, i, n, F.substring("line", start + 1 + F.col("shift"), length)).alias("segment"),
                       ((F.col("less") == 0) & (F.col("shift") == 0)).alias("own"), "h1")


def _common(a: Column, b: Column, side) -> Column:
    """Length of the longest common prefix (``side`` F.left) or suffix (F.right), by halving steps."""
    most = F.least(F.char_length(a), F.char_length(b))
    steps = F.array(*[F.lit(1 << k) for k in range(20, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda got, step: F.when(
        (got + step <= most) & (side(a, got + step) == side(b, got + step)), got + step).otherwise(got))


def banded_distance(a: Column, b: Column, k: int = TAU) -> Column:
    """Edit distance of two arrays of characters (``a`` no longer than ``b`` plus ``k`` and the reverse) by a
    bit-parallel band of ``2k + 1`` diagonals; any value over ``k`` stands for "more than k".

    Bit r at column j is row j - k + r of the edit matrix. The distance is followed down the band's last
    diagonal, from ``k``, until it meets the last row, then along that row."""
    width = 2 * k + 1
    mask, top, next_top = (1 << width) - 1, 1 << (width - 1), 1 << (width - 2)
    m = F.size(a)
    lit = lambda v: F.lit(v).cast("long")
    start = F.struct(lit(mask & ~((1 << k) - 1)).alias("vp"), lit(0).alias("vn"), lit(k).alias("dist"), lit(next_top).alias("row"))

    def step(s: Column, j: Column) -> Column:
        c = F.get(b, j)
        match = lit(0)
        for r in range(width):
            at = j + (r - k)
            match = match.bitwiseOR(F.when((at >= 0) & (at < m) & (F.get(a, F.greatest(at, F.lit(0))) == c), lit(1 << r)).otherwise(lit(0)))
        # two levels of structs keep each word computed once
        one = F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), match.alias("x"), s["dist"].alias("dist"), s["row"].alias("row"))
        two = F.transform(F.array(one), lambda t: F.struct(
            t["vp"].alias("vp"), t["vn"].alias("vn"), t["dist"].alias("dist"), t["row"].alias("row"),
            (((t["x"].bitwiseAND(t["vp"])) + t["vp"]).bitwiseAND(mask).bitwiseXOR(t["vp"])).bitwiseOR(t["x"]).bitwiseOR(t["vn"]).alias("d0")))
        three = F.transform(two, lambda t: F.struct(
            t["d0"].alias("d0"), t["dist"].alias("dist"), t["row"].alias("row"),
            t["vn"].bitwiseOR(F.bitwise_not(t["d0"].bitwiseOR(t["vp"])).bitwiseAND(mask)).alias("hp"),
            t["d0"].bitwiseAND(t["vp"]).alias("hn")))
        down = j < m - k            # still on the last diagonal
        done = F.transform(three, lambda t: F.struct(
            t["hn"].bitwiseOR(F.bitwise_not(F.shiftright(t["d0"], 1).bitwiseOR(t["hp"])).bitwiseAND(mask)).alias("vp"),
            F.shiftright(t["d0"], 1).bitwiseAND(t["hp"]).alias("vn"),
            F.when(down, t["dist"] + F.when(t["d0"].bitwiseAND(top) == 0, lit(1)).otherwise(lit(0)))
            .otherwise(t["dist"] + F.when(t["hp"].bitwiseAND(t["row"]) != 0, lit(1)).otherwise(lit(0))
                       - F.when(t["hn"].bitwiseAND(t["row"]) != 0, lit(1)).otherwise(lit(0))).alias("dist"),
            F.when(down, t["row"]).otherwise(F.shiftright(t["row"], 1)).alias("row")))
        return F.when(s["dist"] > 3 * k, s).otherwise(F.get(done, F.lit(0)))        # no way back under k

    end = F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), start, step)
    plain = F.greatest(F.size(a), F.size(b)).cast("long")
    return F.when(F.least(F.size(a), F.size(b)) == 0, plain).otherwise(end["dist"])


def within_edits(a: Column, b: Column, k: int = TAU) -> Column:
    """Are two lines within ``k`` edits? Trims what they share at both ends, then runs the band.

    What is left differs in its first and its last character, so an edit is at either end; up to two edits leave all
    between them as it is. Lines without that are more than two edits apart and need no band."""
    la, lb = F.char_length(a), F.char_length(b)
    one = F.array(F.struct(a.alias("a"), b.alias("b"), _common(a, b, F.left).alias("p")))
    rest = F.transform(one, lambda t: F.struct(F.substring(t["a"], t["p"] + 1, F.char_length(t["a"])).alias("a"),
                                               F.substring(t["b"], t["p"] + 1, F.char_length(t["b"])).alias("b")))
    rest = F.transform(rest, lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), _common(t["a"], t["b"], F.right).alias("s")))
    cut = F.transform(rest, lambda t: F.struct(F.left(t["a"], F.char_length(t["a"]) - t["s"]).alias("a"),
                                               F.left(t["b"], F.char_length(t["b"]) - t["s"]).alias("b")))
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    band = lambda t: F.get(F.transform(F.array(F.struct(chars(t["a"]).alias("a"), chars(t["b"]).alias("b"))),
                                       lambda u: banded_distance(u["a"], u["b"], k)), F.lit(0))
    between = lambda t: F.contains(t["b"], F.substring(t["a"], F.lit(2), F.greatest(F.char_length(t["a"]) - 2, F.lit(0))))
    far = F.transform(cut, lambda t: F.when(between(t), band(t)).otherwise(F.lit(k + 1).cast("long")) if k <= 2 else band(t))
    return (F.abs(la - lb) <= k) & (F.get(far, F.lit(0)) <= k)


def within_budget(a: Column, b: Column) -> Column:
    """Are two lines within the edits that the longer one allows? The band is as wide as the budget."""
    size = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(size >= BUDGETS[2], within_edits(a, b, 2)).when(size >= BUDGETS[1], within_edits(a, b, 1)).otherwise(F.lit(False))


def near_repeats(docs: DataFrame, firsts: DataFrame, scratch: Scratch, text: str, key: str) -> DataFrame:
    """(h1, h2) of the distinct lines that have an earlier, different line within the budget. ``firsts``:
    (h1, h2, first, n), a row per distinct line."""
    lines = _lines(docs, text, key).withColumn("size", F.char_length("line")).filter(F.col("size") >= BUDGETS[1] - 1)
    total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = (firsts.filter((F.col("n") > 1) & (F.col("n") * (1 << HOT_BITS) >= total))
              .select("h1", "h2", F.col("first.doc").alias("at_doc"), F.col("first.pos").alias("at_pos")))
    once = (lines.join(F.broadcast(common), ["h1", "h2"], "left")           # at most 2^16 rows by its filter
            .filter(F.col("at_doc").isNull() | ((F.col("doc") == F.col("at_doc")) & (F.col("pos") == F.col("at_pos")))))
    looked = _lookups(once)
    group = W.partitionBy("segment")
    met = (looked.withColumn("least", F.min("h1").over(group)).withColumn("most", F.max("h1").over(group))
           .withColumn("any_own", F.max("own").over(group))
           .filter((F.col("least") != F.col("most")) & F.col("any_own")).select("segment", "own", "h1").distinct())
    met = scratch.write(met, "met")
    # keys with the same lines ask the same question: one of them is enough
    same = met.groupBy("segment").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("h1", "own")).alias("x"),
                                      F.bit_xor(F.xxhash64("own", F.lit(1), "h1")).alias("y"))
    same = same.groupBy("c", "x", "y").agg(F.min("segment").alias("segment")).select("segment")
    met = scratch.write(met.join(same, "segment", "left_semi"), "asked")
    ids = met.select("h1").distinct()
    residue = F.pmod("h1", F.lit(RESIDUES))
    places = firsts.join(ids, "h1", "left_semi").select("h1", "h2", "first")
    thin = ids.select(residue.alias("r")).distinct()                         # at most 2^20 rows by the modulus
    texts = (once.select("doc", "pos", "line", "h1").withColumn("r", residue).join(F.broadcast(thin), "r", "left_semi")
             .join(places.withColumnRenamed("h1", "g1"),
                   (F.col("h1") == F.col("g1")) & (F.col("doc") == F.col("first.doc")) & (F.col("pos") == F.col("first.pos")))
             .select("h1", "h2", "first", "line").dropDuplicates(["h1", "h2"]))
    texts = scratch.write(texts, "texts")
    rows = scratch.write(met.join(texts, "h1"), "compared")
    side = lambda p, own: (rows.filter("own") if own else rows).select(
        F.col("segment").alias("segment"), *(F.col(c).alias(f"{p}_{c}") for c in ("h1", "h2", "first", "line")))
    removed = []
    for asks, has, asks_own in (("a", "b", False), ("b", "a", True)):
        # the line that goes asks; the segment is one of the partner's own, or one of its own
        left, right = side(asks, asks_own), side(has, not asks_own)
        hit = left.join(right.withColumnRenamed("segment", "s2"), (F.col("segment") == F.col("s2"))
                        & (F.col(f"{has}_first") < F.col(f"{asks}_first"))
                        & (F.abs(F.char_length("a_line") - F.char_length("b_line")) <= TAU)
                        & within_budget(F.col("a_line"), F.col("b_line")), "left_semi")
        removed.append(hit.select(F.col(f"{asks}_h1").alias("h1"), F.col(f"{asks}_h2").alias("h2")))
    return scratch.write(removed[0].union(removed[1]).distinct(), "near")


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with the text's repeated lines taken out, and ``n_lines`` (not blank) and ``n_removed``."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    docs = docs.drop("n_lines", "n_removed")
    place = F.struct("key", "doc", "pos")
    firsts = scratch.write(_lines(docs, text, key).groupBy("h1", "h2")
                           .agg(F.min(place).alias("first"), F.count("*").alias("n")), "firsts")
    gone = near_repeats(docs, firsts, scratch, text, key)
    kept = (firsts.join(gone, ["h1", "h2"], "left_anti").groupBy(F.col("first.doc").alias("_doc"))
            .agg(F.array_sort(F.collect_list("first.pos")).alias("_kept")))
    # the kept line numbers, spelt out as one flag a line up to the last kept one
    flags = F.flatten(F.transform("_kept", lambda p, i: F.concat(
        F.array_repeat(F.lit(False), p - F.when(i > 0, F.get(F.col("_kept"), i - 1)).otherwise(-1) - 1), F.array(F.lit(True)))))
    all_lines = F.split(text, "\n")
    stays = F.filter("_lines", lambda x, i: (F.trim(x) == "") | F.coalesce(F.get(F.col("_flags"), i), F.lit(False)))
    filled = lambda c: F.coalesce(F.size(F.filter(c, lambda x: F.trim(x) != "")), F.lit(0))
    columns = docs.columns
    out = (docs.withColumn("_doc", _identity(text, key)).join(kept, "_doc", "left")
           .withColumn("_lines", all_lines).withColumn("_flags", flags).withColumn("_stay", stays))
    return (out.withColumn("n_lines", filled("_lines")).withColumn("n_removed", F.col("n_lines") - filled("_stay"))
            .withColumn(text, F.array_join("_stay", "\n")).select(*columns, "n_lines", "n_removed"))
