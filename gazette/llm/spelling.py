"""Spelling variants among the words of a corpus, found by PartEnum signatures of letter multisets.

A word's letters with their occurrence numbers ("e1", "e2") are a binary vector. One inserted or deleted letter changes
one of its dimensions, one replaced letter two, so words one edit apart lie at a Hamming distance of at most two.
The dimensions are dealt into PARTS parts. Two vectors at distance two differ in two parts at most, so they agree on all
parts but some two: every choice of two parts left out gives one signature, the hashes of the other parts, and near
words have a signature in common. Equal signatures meet in an equi-join.

Order is used too, or all words of the same few letters would meet. An edit lies in the first or in the second half of
the shorter word and leaves the other half as it is, so a signature also holds a half and the length it is a half of: for
the word's own length, and for one letter less, as the partner may be the shorter one. A pair meets under the
first choice of parts and the first half that it shares and is verified there, once.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.session import stored

PARTS = 4
#: Bits of a part's hash; a chance collision makes a candidate more and loses none.
BITS = 15
#: Pairs of parts that a signature leaves out, as bit masks.
LEFT_OUT = [1 << i | 1 << j for i, j in combinations(range(PARTS), 2)]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-zÀ-ÿ]+"


def words(docs: DataFrame, key: str = "doc_id", body: str = "text", every: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n): all words of at least `shortest` code points with at least `least` occurrences in whole texts.

    Words are runs of letters with A-Z lowered; where `every` divides the crc32 of "<key>:<run>", the run loses the code point
    at crc32 modulo its length. Counts are combined in the map tasks, so a very common word is one row per task.

    A null text has no words, a null key is written as nothing before the colon, rows that repeat a key are texts
    of their own, and a text of any length is read whole. Other columns are not read. An empty table gives no word.
    """
    low = F.translate(F.col(body).cast("string"), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("w"))
    hashed = runs.filter(F.length("w") >= shortest).withColumn("h", F.crc32(F.concat("k", F.lit(":"), "w").cast("binary")))
    at = (F.col("h") % F.length("w")).cast("int")
    shorter = F.concat(F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))
    found = hashed.select(F.when(F.col("h") % every == 0, shorter).otherwise(F.col("w")).alias("word"))
    return found.filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def part_hashes(vocabulary: DataFrame) -> DataFrame:
    """The vocabulary with `parts`: the hashes of all parts of a word's letter multiset in one number, BITS for each."""
    # Arrays that several expressions read are columns of their own, so each is made once a word.
    sorted_ = vocabulary.withColumn("letters", F.array_sort(F.split("word", "")))
    # The occurrence number of a letter is its distance from the first equal one in the sorted letters.
    dims = F.transform("letters", lambda c, i: F.xxhash64(c, i + 1 - F.array_position("letters", c)))
    # The low bits of a dimension's hash choose the part; others are folded into that part's field.
    group = lambda h: h.bitwiseAND(F.lit(PARTS - 1).cast("bigint"))

    def field(h: Column) -> Column:
        weight = F.lit(1 << BITS * (PARTS - 1)).cast("bigint")
        for g in range(PARTS - 1):
            weight = F.when(group(h) == g, F.lit(1 << BITS * g).cast("bigint")).otherwise(weight)
        return F.shiftrightunsigned(h, 16).bitwiseAND(F.lit((1 << BITS) - 1).cast("bigint")) * weight

    parts = F.aggregate(dims, F.lit(0).cast("bigint"), lambda a, h: a.bitwiseXOR(field(h)))
    return sorted_.withColumn("parts", parts).drop("letters")


def _kept(mask: int) -> int:
    """The bits of the parts that a signature keeps."""
    return sum(((1 << BITS) - 1) << BITS * g for g in range(PARTS) if not mask >> g & 1)


def signatures(vocabulary: DataFrame, longer: bool) -> DataFrame:
    """(word, n, long, parts, kind, sig): the signatures of every word as the shorter or equal word of a pair, and
    with `longer` also those as its longer word. kind: twice the mask of the parts left out, and one if the half is the front.
    """
    measured = part_hashes(vocabulary.select("word", "n", F.length("word").alias("long")))
    halves = []
    for less in (0, 1) if longer else (0,):
        size = F.col("long") - less
        half = F.floor(size / 2).cast("int")
        halves.append(F.struct(size.alias("size"), F.lit(1).alias("front"), F.substring("word", F.lit(1), half).alias("half")))
        halves.append(F.struct(size.alias("size"), F.lit(0).alias("front"), F.substring("word", half + less + 1, F.col("long")).alias("half")))
    rows = measured.withColumn("h", F.explode(F.array(*halves)))
    masks = F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(_kept(m)).cast("bigint").alias("bits")) for m in LEFT_OUT])
    rows = rows.withColumn("m", F.explode(masks))
    kind = F.col("m.mask") * 2 + F.col("h.front")
    sig = F.xxhash64(F.col("parts").bitwiseAND(F.col("m.bits")), kind, "h.size", "h.half")
    return rows.select("word", "n", "long", "parts", kind.alias("kind"), sig.alias("sig"))


def _first_mask(differ: Column) -> Column:
    """The choice of parts under which a pair is verified: of those that hold all parts that differ, the first."""
    first = F.lit(None).cast("int")
    for m in reversed(LEFT_OUT):
        first = F.when(differ.bitwiseAND(F.lit(~m)) == 0, F.lit(m)).otherwise(first)
    return first


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b) with a < b: all pairs of words that differ by exactly one inserted, deleted or replaced code point, each once.

    vocabulary: (word, n), every word once. Words of fewer than two code points take part like others; null words are left out.
    """
    vocabulary = vocabulary.filter("word IS NOT NULL")
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    differ = F.lit(0)
    for g in range(PARTS):
        bits = F.lit(((1 << BITS) - 1) << BITS * g).cast("bigint")
        differ = differ + F.when(x("parts").bitwiseXOR(y("parts")).bitwiseAND(bits) != 0, 1 << g).otherwise(0)
    half = F.floor(x("long") / 2).cast("int")
    same_front = F.substring(x("word"), F.lit(1), half) == F.substring(y("word"), F.lit(1), half)
    roles = (y("long") == x("long") + 1) | (y("long") == x("long")) & (x("word") < y("word"))
    once = (F.shiftright(x("kind"), 1) == _first_mask(differ)) & ((x("kind") % 2 == 1) | ~same_front)
    near = F.levenshtein(x("word"), y("word"), 1) == 1
    # Both sides are many times the vocabulary, so neither is ever copied to all executors.
    met = signatures(vocabulary, False).alias("x").hint("merge").join(
        signatures(vocabulary, True).alias("y"), (x("sig") == y("sig")) & (x("kind") == y("kind")) & roles & once & near)
    swap = x("word") > y("word")
    pick = lambda c, first: F.when(swap == first, y(c)).otherwise(x(c))
    return met.select(pick("word", True).alias("a"), pick("n", True).alias("n_a"), pick("word", False).alias("b"), pick("n", False).alias("n_b"))


def _roots(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """(word, root): the last word that forms (word, form) lead to, by pointer doubling.

    A form is at least twice as frequent as its word, so a chain has fewer than 64 steps and seven rounds reach its end.
    Every round is a written table.
    """
    jumps = stored(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = stored(jumps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        jumps = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return jumps
    raise RuntimeError("the forms run in a circle")


def variants(vocabulary: DataFrame, times: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every row of vocabulary (word, n).

    n_near: words one edit away. form: of those the one with the largest n, of equal ones the first in code-point order, if
    that n is at least `times` the word's own; else null. root: where forms lead from the word, the word itself
    if it has none. An empty vocabulary gives no row.
    """
    pairs = stored(near_pairs(vocabulary), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    best = F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("word")))
    around = both.groupBy("a").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = vocabulary.join(around.withColumnRenamed("a", "word").select("word", "n_near", F.col("best.word").alias("other"), (-F.col("best.less")).alias("other_n")), "word", "left")
    leads = F.col("other_n") >= times * F.col("n")
    made = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(leads, F.col("other")).alias("form"),
                                F.when(leads, F.col("other_n")).alias("form_n")), "forms")
    roots = _roots(made.filter("form IS NOT NULL"))
    return made.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
