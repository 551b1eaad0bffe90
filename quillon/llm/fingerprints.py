"""Fingerprints of weighted word sets by consistent weighted sampling, with DataFrame functions only.

Coordinate k of a fingerprint is a pair (term, level) drawn so that two texts draw the same pair with a probability
equal to the generalised Jaccard similarity of their word counts: for each term, r and c are gamma(2, 1) and b uniform,
all hashed from (term, k); level = floor(ln(weight) / r + b), and the term with the least ln c - r * (level - b) - r wins.

A text and its edited text share most of their words. They are counted together, so the draws of a term serve both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import table

COORDINATES = 48
#: Coordinates of a turn. A row stands once for each turn and draws so many samples in it: an expression for each of all
#: coordinates makes plans and generated code that fill the driver's memory.
TURN = 8
#: A coordinate keeps this many bits of the pair's hash.
PAIR_BITS = 24
#: Pairs of a term and its count whose draws are kept at hand, and of how many documents one is asked for such pairs.
DRAWN, SAMPLED = 1 << 15, 32
#: Spans of ids for each shuffle partition, so that hashing deals them out evenly, and spans at most.
SPANS, MOST_SPANS = 8, 8192
WHITE = "\t\n\x0b\x0c\r"


def flat(text: Column) -> Column:
    """Every ASCII white space is a blank; as many characters as before."""
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def _uniforms(h: Column, bits: tuple[int, ...]) -> list[Column]:
    """Numbers in (0, 1) from stretches of so many bits of a hash, the lowest first."""
    out, at = [], 0
    for n in bits:
        out.append((F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << n) - 1)) + 0.5) * F.lit(2.0**-n))
        at += n
    return out


def _known(x: Column) -> Column:
    """A number that Spark can't tell is never null."""
    return F.coalesce(x, F.lit(0.0))


def sample(term: Column, n: Column, k: Column) -> Column:
    """The race of a term that stands n times in coordinate k (an int) as one long: its rank above, the pair's mark below.

    Two hashes of (term, k) give r, c and b. The pair's mark is the end of the first one, which says next to nothing of
    the rank, combined with the level.
    """
    h = F.xxhash64(term, 2 * k)
    u1, u2 = _uniforms(h, (32, 31))
    u3, u4, b = _uniforms(F.xxhash64(term, 2 * k + 1), (21, 21, 21))
    r, log_c = -_known(F.ln(u1 * u2)), _known(F.ln(-_known(F.ln(u3 * u4))))
    level = F.floor(_known(_known(F.ln(n.cast("double"))) / r) + b)
    rank = log_c - r * (level - b) - r
    # Ranks lie between -96 and 32: 2**31 steps for each unit.
    fixed = F.floor((F.least(F.greatest(rank, F.lit(-96.0)), F.lit(31.0)) + 96) * 2.0**31)
    return F.shiftleft(fixed, PAIR_BITS).bitwiseOR(h.bitwiseXOR(level).bitwiseAND(F.lit((1 << PAIR_BITS) - 1)))


def turns() -> Column:
    """The turns that take all coordinates."""
    return F.array(*(F.lit(t) for t in range(COORDINATES // TURN)))


def raced(held: DataFrame, keys: list[str], race: Callable[[Column], Column], *more: Column) -> DataFrame:
    """keys, turn, f0, f1, ... and ``more`` of rows with a turn: the least race of each of its coordinates."""
    least = [F.min(race(F.col("turn") * TURN + i)).alias(f"f{i}") for i in range(TURN)]
    return held.groupBy(*keys, "turn").agg(*least, *more)


def taken(k: int, when: Column) -> Column:
    """Aggregate over rows of ``raced``: the least race of coordinate k of those for which ``when`` holds."""
    return F.min(F.when(when & (F.col("turn") == k // TURN), F.col(f"f{k % TURN}")))


def drawn(counts: DataFrame) -> DataFrame:
    """term, n, races: the samples of the pairs of a term and its count that are in most of the documents of ``counts``.

    At most DRAWN rows of 8 * COORDINATES bytes. They only spare the same draws again: results don't depend on them.
    """
    most = counts.where("term is not null").groupBy("term", "n").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.col("rows").desc()).limit(DRAWN)
    some = most.select("term", "n", F.explode(turns()).alias("turn"))
    some = some.select("term", "n", "turn", F.array(*(sample(F.col("term"), F.col("n"), F.col("turn") * TURN + i) for i in range(TURN))).alias("races"))
    own = some.groupBy("term", "n").agg(F.array_sort(F.collect_list(F.struct("turn", "races"))).alias("own"))
    return own.select("term", "n", F.flatten("own.races").alias("races"))


def winners(rows: DataFrame, keys: list[str], known: DataFrame) -> DataFrame:
    """keys, f0, f1, ...: the least sample of each coordinate over the rows (term, n) of the keys; null without terms."""
    held = rows.join(F.broadcast(known), ["term", "n"], "left").withColumn("turn", F.explode(turns()))
    term, n = F.col("term"), F.col("n")
    race = lambda k: F.when(term.isNotNull(), F.coalesce(F.get("races", k), sample(F.coalesce(term, F.lit(0)), F.coalesce(n, F.lit(1)), k)))
    return raced(held, keys, race).groupBy(*keys).agg(*(taken(k, F.lit(True)).alias(f"f{k}") for k in range(COORDINATES)))


def marks(prefix: str) -> Column:
    """The fingerprint array<int> of the winners; null where no term took part."""
    own = F.array(*(F.col(f"{prefix}{k}").bitwiseAND(F.lit((1 << PAIR_BITS) - 1)).cast("int") for k in range(COORDINATES)))
    return F.when(F.col(f"{prefix}0").isNotNull(), own)


def counted(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, term, n of rows (keys, word); the empty word is a null term."""
    return words.groupBy(*keys, F.when(F.col("word") != "", F.xxhash64("word")).alias("term")).agg(F.count(F.lit(1)).alias("n"))


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, fingerprint array<int>, one row for each combination of keys; null where the text has no words.

    Words are what ASCII white space delimits. Give rows that are already dealt by some of the keys: the groupings then
    need no shuffle.
    """
    counts = counted(texts.select(*keys, F.explode_outer(F.split(flat(F.col(text_col)), " ")).alias("word")), keys)
    return winners(counts, keys, drawn(counts)).select(*keys, marks("f").alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal coordinates. Two texts without words are alike, one without is not like any with words."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / F.lit(float(COORDINATES)))


def shown(a: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), PAIR_BITS // 4, "0")), ""), F.lit(""))


def _below(values: list[int], x: Column) -> Column:
    """How many of the ascending values are less than x, by bisection."""
    steps = [1 << i for i in range(len(values).bit_length() - 1, -1, -1)]
    held = F.lit(values)
    move = lambda n, step: F.when((n + step <= len(values)) & (F.get(held, n + step - 1) < x), n + step).otherwise(n)
    return F.aggregate(F.lit(steps), F.lit(0), move) if values else F.lit(0)


def span_ends(ids: DataFrame, spans: int) -> list[int]:
    """The largest ids of spans that hold about as many rows each: at most ``spans`` numbers, whatever the ids are."""
    shares = [i / spans for i in range(1, spans)] or [0.5]
    cuts = ids.agg(F.percentile_approx("doc_id", shares, 10 * spans).alias("at")).first()["at"] or []
    ends = ids.groupBy(_below(sorted(set(cuts)), F.col("doc_id")).alias("span")).agg(F.max("doc_id").alias("end"))
    return sorted(r["end"] for r in ends.select("end").collect())


def with_next(docs: DataFrame, ends: list[int]) -> DataFrame:
    """span, doc_id, text, next_id, next_text: each document and the next one in descending order, the last being
    followed by the first. One shuffle of the texts, by span; the largest document of a span is a guest at the end of
    the span above (of the last span: of the first), so that every span has the next of its last document."""
    top = _below(ends[:-1], F.col("doc_id"))
    here, there = F.struct(F.col("span"), F.lit(0).alias("guest")), F.struct(((F.col("span") + 1) % len(ends)).alias("span"), F.lit(1).alias("guest"))
    placed = docs.withColumn("span", top).withColumn("at", F.explode(F.when(F.col("doc_id") == F.get(F.lit(ends), F.col("span")), F.array(here, there)).otherwise(F.array(here))))
    placed = placed.select("at.span", "at.guest", "doc_id", "text")
    order = Window.partitionBy("span").orderBy("guest", F.col("doc_id").desc(), F.col("text").desc())
    again = (F.lag("doc_id").over(order) == F.col("doc_id")) & (F.lag("guest").over(order) == F.col("guest"))
    once = placed.withColumn("again", F.coalesce(again, F.lit(False))).where("not again")
    rows = once.withColumn("next_id", F.lead("doc_id").over(order)).withColumn("next_text", F.lead("text").over(order))
    return rows.where("guest = 0").select("span", "doc_id", "text", "next_id", "next_text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited text has its
    last floor(n_chars / 3) code points replaced by as many of the first of the next document in descending order (or
    all of them); the last is followed by the first, a single document by itself. Texts of any length are read whole;
    null texts are empty; a text without words has an empty fingerprint. Repeated rows of one id count once (of
    different texts the greatest), rows without an id not at all; ids may lie as far apart as they like; other columns
    are ignored, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).where("doc_id is not null")
    spans = min(MOST_SPANS, SPANS * int(spark.conf.get("spark.sql.shuffle.partitions")))
    ends = span_ends(source.select("doc_id"), spans)
    if not ends:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    rows = with_next(source, ends)
    n, third = F.length("text"), F.expr("cast(length(text) div 3 as int)")
    cut = lambda text, begin, size: F.substring(text, begin, size)
    sha = F.sha2(F.concat(cut(F.col("text"), F.lit(1), n - third), cut(F.col("next_text"), F.lit(1), third)), 256)
    rows = rows.select("span", "doc_id", "next_id", n.alias("n"), third.alias("third"), sha.alias("sha"), flat(F.col("text")).alias("text"), flat(F.col("next_text")).alias("next_text"))
    c = F.col
    rows = rows.withColumn("head", cut(c("text"), F.lit(1), c("n") - c("third")))
    rows = rows.withColumn("open", F.substring_index("head", " ", -1))  # a word that the cut may go through
    both = cut(c("head"), F.lit(1), F.length("head") - F.length("open"))
    own = F.concat("open", cut(c("text"), c("n") - c("third") + 1, c("third")))
    new = F.concat("open", cut(c("next_text"), F.lit(1), c("third")))
    # Numbers of a document travel among its words, as hexadecimal ones of a kind of their own.
    numbers = [*(F.substring("sha", 16 * i + 1, 16) for i in range(4)), F.hex(c("n").cast("long")), F.hex("next_id")]
    parts = F.array(*(F.struct(F.lit(k).alias("kind"), x.alias("words")) for k, x in enumerate([both, own, new, *numbers])))
    words = rows.select("span", "doc_id", F.explode(parts).alias("p")).select("span", "doc_id", "p.kind", F.explode(F.split("p.words", " ")).alias("word"))
    term = F.when(c("kind") < 3, F.xxhash64("word")).otherwise(F.conv("word", 16, -10).cast("long"))
    words = words.where((c("word") != "") | (c("kind") > 2)).select("span", "doc_id", F.greatest(c("kind") - 2, F.lit(0)).alias("number"), term.alias("term"), c("kind").isin(0, 1).cast("long").alias("own"), c("kind").isin(0, 2).cast("long").alias("new"))
    # All groupings lie within a span: no more shuffles. Sides: 0 both texts, 1 the text, 2 the edited one, 3 on numbers.
    counts = words.groupBy("span", "doc_id", "number", "term").agg(F.sum("own").alias("own"), F.sum("new").alias("new"))
    row = lambda side, n: F.struct(side.cast("int").alias("side"), n.cast("long").alias("n"))
    both, own, new = row(F.lit(0), c("own")), row(F.lit(1), c("own")), row(F.lit(2), c("new"))
    sides = F.when(c("number") > 0, F.array(row(c("number") + 2, F.lit(1)))).when(c("own") == c("new"), F.array(both)).when(c("new") == 0, F.array(own)).when(c("own") == 0, F.array(new)).otherwise(F.array(own, new))
    terms = counts.select("span", "doc_id", "term", F.explode(sides).alias("s")).select("span", "doc_id", "s.side", "s.n", "term")
    terms = terms.select("span", "doc_id", "side", F.when(c("side") < 3, c("n")).otherwise(-1).alias("n"), "term")
    # Draws of the pairs that are frequent in one document of so many are made once and not for each document.
    few = source.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).select("doc_id", F.explode(F.split(flat(c("text")), " ")).alias("word"))
    known = drawn(counted(few.where("word <> ''"), ["doc_id"]))
    held = terms.join(F.broadcast(known), ["term", "n"], "left").withColumn("turn", F.explode(F.when(c("side") < 3, turns()).otherwise(F.array(F.lit(0)))))
    race = lambda k: F.coalesce(F.get("races", k), sample(c("term"), F.greatest(c("n"), F.lit(1)), k))
    won = raced(held, ["span", "doc_id", "side"], race, F.max("term").alias("value"))
    of = lambda name, side: [taken(k, c("side").isin(0, side)).alias(f"{name}{k}") for k in range(COORDINATES)]
    values = [F.max(F.when(c("side") == i + 3, c("value"))).alias(f"v{i}") for i in range(len(numbers))]
    won = won.groupBy("span", "doc_id").agg(*of("own", 1), *of("new", 2), *values)
    digest = F.lower(F.concat(*(F.lpad(F.hex(f"v{i}"), 16, "0") for i in range(4))))
    found = table(won.select("doc_id", digest.alias("sha"), c("v4").alias("n_chars"), c("v5").alias("next_id"), marks("own").alias("own"), marks("new").alias("changed")), "fingerprints")
    after = found.select(c("doc_id").alias("next_id"), c("own").alias("after"))
    return found.join(after, "next_id").select(
        "doc_id",
        "n_chars",
        c("sha").alias("edited_sha256"),
        shown(c("own")).alias("fingerprint"),
        shown(c("changed")).alias("edited_fingerprint"),
        likeness(c("own"), c("changed")).alias("near_edited"),
        likeness(c("own"), c("after")).alias("near_next"),
    )
