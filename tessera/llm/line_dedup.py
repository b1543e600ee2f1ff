"""Fuzzy line dedup, in DataFrame and SQL functions only.

1.  Texts split at newlines. A line is normalised (lower case, runs of characters
    other than letters and digits as one space, trimmed; a line of marks alone
    keeps them). Equal normalised lines are one class.
2.  A line's distinct words are hashed, and the smallest hashes, in order, are its
    sketch. A word of 1, 2, 3 or more characters counts 1, 2, 4 or 8 fold, so that
    lines do not meet under the words that all have.
3.  Pigeonhole blocks: four neighbours of the sketch are one block (three, with one
    left out of four as well, for lines of few words). A changed word spoils the
    few blocks it stands in; lines that agree in most words share a block whole.
    Classes meet under each block that two or more of them have.
    (Blocks of the bits of a 64-bit SimHash find a quarter of the like lines: a
    tenth of the words changed turns 9 of 64 bits. README has the figures.)
4.  Those that meet and share nearly half of their sketches are candidates. They
    link when their edit distance is at most ``1 - similarity`` of the longer line.
    Small buckets give their pairs. In a larger one all classes are held against
    leaders. What that does not connect with most of a bucket meets all of it, if it
    is little; if not, in buckets of the block and one more sketch word: of a class
    the words that fewest of the bucket have, but as many as a candidate pair must
    share, less one. Those that need to share no more than all of a bucket do meet
    all of it. So every candidate pair is compared or connected.
5.  Of each connected group of classes the occurrence with the smallest id and
    line number stays; all other occurrences go.

Defined results: a null text stays null and has no lines; a null id is an id of
its own, smaller than all others; rows that repeat both id and text are one
occurrence and are treated alike; a text of which nothing stays is empty; empty
tables give none; other columns are passed on.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import dropped, packed, released, written
from .components import components


@dataclass(frozen=True)
class Settings:
    min_words: int = 3  #: distinct words; lines of fewer meet as exact copies only
    similarity: float = 0.8
    blocks: int = 12  #: of four neighbours in the sketch
    few: int = 12  #: lines of at most so many distinct words have blocks of three as well
    alike: int = 45  #: percent of the shorter sketch that candidates have in common
    by_chars: int = 1000  #: longer lines are compared by words
    light: int = 32  #: buckets of up to so many classes give all their pairs at once
    #: Rows of so many bytes at most are sent to all executors; more are joined by a shuffle.
    sent_bytes: int = 16 << 20
    rounds: int = 3  #: of leaders in larger buckets at most, before they are split

    @property
    def reach(self) -> Fraction:
        """Most edits for each character of the longer line; a fraction, so that a tie is no matter of rounding."""
        return 1 - Fraction(str(self.similarity))

    @property
    def width(self) -> int:
        return self.blocks + 3


def split_words(line: Column) -> Column:
    """The lower-case words: runs of letters and digits. Single blanks need no replacing."""
    marks = F.regexp_replace(line, r"[^\p{L}\p{N} ]+", " ")
    return F.array_remove(F.split(F.lower(marks), " "), "")


def with_words(lines: DataFrame) -> DataFrame:
    """``words`` of ``raw``. A line of marks alone has its runs without white space instead."""
    marks = F.array_remove(F.split(F.regexp_replace("raw", r"[\s\p{Z}]+", " "), " "), "")
    kept = [c for c in lines.columns if c != "raw"]
    lines = lines.select(*kept, "raw", once(split_words(F.col("raw"))).alias("words"))
    return lines.select(*kept, F.when(F.size("words") > 0, F.col("words")).otherwise(marks).alias("words"))


def once(value: Column) -> Column:
    """A value that is computed once, however many columns and filters use it."""
    return F.explode(F.array(value))


def every_line(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, line, words) for each line that is not blank; mark tells texts of one id apart."""
    base = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    return with_words(base).where(F.size("words") > 0)


def sketch(words: Column, s: Settings) -> Column:
    """The smallest hashes of the distinct words, in order; null for lines of few words."""
    ranks = F.transform(words, lambda w: F.call_function("shiftrightunsigned", F.hash(w).bitwiseAND(F.lit(0x7FFFFFFF)), F.least(F.length(w), F.lit(4)) - 1))
    return F.slice(F.array_distinct(F.sort_array(ranks)), 1, s.width)


def hashed_lines(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, mark, line, h1, chars, norm, sketch) for each line."""
    lines = every_line(docs).select("doc_id", "mark", "line", F.xxhash64("words").alias("h1"), F.array_join("words", " ").alias("norm"), once(sketch(F.col("words"), s)).alias("sketch"))
    return lines.withColumn("chars", F.length("norm")).withColumn("sketch", F.when(F.size("sketch") >= s.min_words, F.col("sketch")))


def block_keys(words: Column, s: Settings) -> Column:
    """A key for each block of the sketch."""
    n = F.size(words)

    def key(upto: Column, *places: int) -> Column:
        return F.when(upto > places[-1], F.xxhash64(*[F.get(words, F.lit(p)) for p in places]))

    long = F.array_compact(F.array(*[key(n, i, i + 1, i + 2, i + 3) for i in range(s.blocks)]))
    first = F.least(n, F.lit(8))
    short = F.array_compact(F.array(*[key(first, i, *p) for i in range(6) for p in ((i + 1, i + 2), (i + 1, i + 3), (i + 2, i + 3))]))
    return F.when(n > s.few, long).when(n < s.few - 3, short).otherwise(F.concat(short, long))


def _small(df: DataFrame, row_bytes: int, s: Settings) -> DataFrame:
    """Marked for sending to all executors if it is known to be small."""
    return F.broadcast(df) if df.count() * row_bytes <= s.sent_bytes else df


def _most(longest: Column, reach: Fraction) -> Column:
    """The whole number of edits that a longest line of so many characters allows."""
    scaled = longest.cast("long") * reach.numerator
    return ((scaled - scaled % reach.denominator) / reach.denominator).cast("int")


def _may_link(a: Column, b: Column, s: Settings) -> Column:
    """Both have (sketch, chars): the lengths allow a link, and the sketches agree."""
    near = F.abs(a["chars"] - b["chars"]) <= _most(F.greatest(a["chars"], b["chars"]), s.reach)
    return near & (100 * F.size(F.array_intersect(a["sketch"], b["sketch"])) >= s.alike * F.least(F.size(a["sketch"]), F.size(b["sketch"])))


def _need(words: Column, s: Settings) -> Column:
    """How many words a candidate pair shares whose shorter sketch is this."""
    return F.ceil(F.size(words) * s.alike / 100).cast("int")


def lettered(words: Column) -> Column:
    """A letter for each word, the same for equal words (of 20,000 letters, by hash)."""
    return F.decode(F.unhex(F.array_join(F.transform(words, lambda w: F.hex(F.pmod(F.hash(w), F.lit(20_000)) + 0x4E00)), "")), "UTF-16BE")


def with_texts(rows: DataFrame) -> DataFrame:
    """(id, norm, letters, longest) of (id, words): the line, a letter for each word, and the characters of the longest word."""
    return rows.select("id", F.array_join("words", " ").alias("norm"), lettered(F.col("words")).alias("letters"), F.array_max(F.transform("words", F.length)).alias("longest"))


def linked(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose edit distance is at most ``reach`` of the longer line."""
    ends, one = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), pairs
    few = 80 * (n := pairs.count()) <= s.sent_bytes
    if few:
        ends, one = F.broadcast(ends), F.broadcast(pairs)
    mine = texts.join(ends, "id", "left_semi")  # no other text is dealt out
    for side, x in (("a", "x"), ("b", "y")):
        one = one.join(mine.select(F.col("id").alias(side), F.struct("norm", "letters", "longest").alias(x)), side)
    if few:  # few bytes, but each pair is work
        one = one.repartition(1 + n // TASK_PAIRS)
    return _like(one, s).select("a", "b")


def _like(one: DataFrame, s: Settings) -> DataFrame:
    """The rows whose texts x and y are like.

    An edit of a word is at most as many edits of characters as the longest word
    has, and one for the blank. Pairs that few enough edits of words take from one to
    the other are like for sure; for the others characters are compared, and
    for lines of more than ``by_chars`` of them the edits of words, each taken as
    one mean word.
    """
    longest = F.greatest(F.length("x.norm"), F.length("y.norm"))
    one = one.select("*", once(longest).alias("most")).withColumn("long", F.col("most") > s.by_chars).withColumn("most", _most(F.col("most"), s.reach))
    one = one.where(F.abs(F.length("x.norm") - F.length("y.norm")) <= F.col("most"))
    word = F.when(F.col("long"), F.greatest(F.length("x.norm"), F.length("y.norm")) / F.greatest(F.length("x.letters"), F.length("y.letters"))).otherwise(F.greatest("x.longest", "y.longest") + 1)
    one = one.withColumn("edits", F.floor(F.col("most") / word).cast("int"))
    return one.where(F.expr("levenshtein(x.letters, y.letters, edits) >= 0 or (not long and levenshtein(x.norm, y.norm, most) >= 0)"))  # -1 beyond the limit


def _pairs_in(rows: DataFrame, s: Settings) -> DataFrame:
    """The candidate pairs of small buckets (at most ``light`` classes each), but those of two that are connected."""
    held = rows.groupBy("key").agg(F.collect_list(F.struct("id", "sketch", "chars", "root")).alias("l"))
    pairs = held.select("l", F.explode("l").alias("p"))
    pairs = pairs.select("p", F.explode(F.filter("l", lambda q: (q["id"] > F.col("p.id")) & (q["root"] != F.col("p.root")) & _may_link(q, F.col("p"), s))).alias("q"))
    return pairs.select(F.col("p.id").alias("a"), F.col("q.id").alias("b"))


def _led(heavy: DataFrame, texts: DataFrame, tested: DataFrame | None, likes: DataFrame | None, step: int, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Holds every class of a bucket against one leader that no leader has linked yet: the pairs compared, their links, and the rows with new marks.

    In one step the order of leaders is the same for all buckets, so classes that meet in many
    buckets mostly have one leader in them; pairs that earlier steps compared keep their result.
    """
    me, ends = F.struct("id", "sketch", "chars", "root"), (F.least("id", "leader.id").alias("a"), F.greatest("id", "leader.id").alias("b"))
    leads = heavy.where("not led").groupBy("key").agg(F.min_by(me, F.struct(F.xxhash64(F.lit(step), "id"), "id")).alias("leader"))
    met = heavy.join(leads, "key").where(F.col("root") != F.col("leader.root"))
    pairs = met.where(_may_link(me, F.col("leader"), s)).select(*ends).distinct()
    pairs = written(pairs.join(tested, ["a", "b"], "left_anti") if tested is not None else pairs, "pairs")
    links = written(linked(pairs, texts, s), "led")
    now = (links if likes is None else likes.union(links)).withColumn("now", F.lit(True))
    marked = heavy.join(leads, "key", "left").select("*", *ends).join(now, ["a", "b"], "left")
    marked = marked.withColumn("led", F.col("led") | F.coalesce("now", F.lit(False)) | F.coalesce(F.col("root") == F.col("leader.root"), F.lit(False)))
    return pairs, links, written(marked.select(*heavy.columns), "heavy")


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of buckets whose classes are not all connected, with the size ``m`` of the bucket."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return rows.join(sizes.select("key", "m"), "key")


def _apart(rows: DataFrame) -> DataFrame:
    """The rows of buckets whose classes are not all connected, with the size ``m`` of the bucket, its largest connected group ``big`` and how many are not of it."""
    groups = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    sizes = groups.groupBy("key").agg(F.sum("n").alias("m"), F.max(F.struct("n", "root")).alias("big")).where("m > big.n")
    return rows.join(sizes.select("key", "m", F.col("big.root").alias("big"), (F.col("m") - F.col("big.n")).alias("apart")), "key")


def _brief_pairs(rows: DataFrame, s: Settings) -> DataFrame:
    """The candidate pairs of each bucket's brief classes and all of it that are not connected."""
    met = F.when(F.col("few"), F.col("apart")).otherwise(F.col("m")) * F.col("m")  # pairs at most
    salts = F.least(F.lit(SALTS), 1 + F.floor(met / TASK_MET)).cast("int")
    side = rows.select("key", F.struct("id", "sketch", "chars", "root", "brief").alias("p"), salts.alias("salts"))
    # a bucket of many pairs is dealt to several tasks: each has all its brief classes, and a part of the others
    x = side.where("p.brief").select("key", "p", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    y = side.select("key", F.col("p").alias("q"), F.pmod("p.id", F.col("salts")).cast("int").alias("salt"))
    met = x.join(y, ["key", "salt"]).where((F.col("p.root") != F.col("q.root")) & (~F.col("q.brief") | (F.col("p.id") < F.col("q.id"))) & _may_link(F.col("p"), F.col("q"), s))
    return met.select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b")).distinct()


def _split(rows: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """The rows with ``brief``, and the rows (key, id, sketch, chars, root) of the smaller buckets that all others but brief ones go to.

    Where few are not of the largest group, these are brief. Elsewhere, words that all of a bucket have make a class brief that needs to share
    no more of them: any other may be its candidate. Two that need more have a word in common among the rarer ones of both: all but as many as
    they must share, less one, in one order for the bucket. None of these is a word that all have, so each split makes the buckets
    smaller and needs one word less: there is a last one.
    """
    few = F.col("apart") <= 4 * s.light
    words = rows.where(~few).select("key", "id", "m", F.explode("sketch").alias("word"))
    often = words.groupBy("key", "word").agg(F.count(F.lit(1)).alias("n"), F.first("m").alias("m")).where("n > 1")  # a word of one class counts as the rarest
    often = written(often, "often")
    shared = often.groupBy("key").agg(F.sum(F.when(F.col("n") == F.col("m"), 1).otherwise(0)).alias("by_all"))
    brief = F.when(few, F.col("root") != F.col("big")).otherwise(_need(F.col("sketch"), s) <= F.col("by_all"))
    rows = written(rows.join(shared, "key", "left").withColumn("few", few).withColumn("brief", brief).drop("by_all"), "split")
    rest = rows.where("not few and not brief")
    need = rest.groupBy("key").agg(F.min(_need(F.col("sketch"), s)).alias("need"))
    order = rest.select("key", "id", F.explode("sketch").alias("word")).join(often.select("key", "word", "n"), ["key", "word"])
    order = order.groupBy("key", "id").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("order"))  # as long as a sketch
    to = rest.join(need, "key").join(order, ["key", "id"])
    left = F.size("order") - F.col("need") + 1  # words of one class come before and give no bucket
    to = to.where(left > 0).select("id", "sketch", "chars", "root", "key", F.explode(F.slice("order", F.lit(1), left)).alias("at"))
    return rows, to.withColumn("key", F.xxhash64("key", "at.word")).drop("at")


def met_classes(classes: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(key, id, m) where m classes, two or more, have the key, and the classes that are in any."""
    keyed = classes.where("sketch is not null").select("id", F.explode(block_keys(F.col("sketch"), s)).alias("key"))
    rows = written(keyed.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("m > 1"), "rows")
    released(classes.sparkSession)
    return rows, written(classes.join(_small(rows.select("id").distinct(), 24, s), "id", "left_semi"), "met")


def _rooted(rows: DataFrame, roots: DataFrame, s: Settings) -> DataFrame:
    """The rows with the root of each id that has one."""
    return rows.join(_small(roots.withColumnRenamed("root", "now"), 32, s), "id", "left").withColumn("root", F.coalesce("now", "root")).drop("now")


def texts_of(met: DataFrame, lines: DataFrame, s: Settings) -> DataFrame:
    """The texts of the classes in ``met``, to be compared; ``lines`` has (h1, norm)."""
    texts = lines.select(F.col("h1").alias("id"), "norm").join(_small(met.select("id"), 24, s), "id", "left_semi").dropDuplicates()
    return packed(with_texts(texts.select("id", F.split("norm", " ").alias("words"))), "texts")


def links_of(rows: DataFrame, met: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """Links (a, b) that connect the classes ``met`` (id, sketch, chars) in the buckets of ``rows`` (key, id, m) as all links of candidate pairs do."""
    spark = rows.sparkSession
    rows = rows.join(met.select("id", "sketch", "chars"), "id").withColumn("root", F.col("id"))

    candidates, tested, likes, roots, step = [], None, None, None, 0
    while True:  # each split makes the buckets smaller, so there is a last one
        heavy = written(rows.where(F.col("m") > s.light).withColumn("led", F.lit(False)), "heavy")
        gained = False
        for _ in range(s.rounds):
            if not (waiting := heavy.where("not led").count()):
                break
            last = heavy
            pairs, found, heavy = _led(heavy, texts, tested, likes, step, s)
            dropped(last)
            released(spark)
            step += 1
            tested, likes = (pairs, found) if tested is None else (tested.union(pairs), likes.union(found))
            if 100 * found.count() < waiting:  # classes that have no leader; what follows finds their links
                break
            gained = True
        # what is connected by now needs no pairs, whichever leaders did it
        if gained:
            roots = components(likes)
        light = rows.where(F.col("m") <= s.light)
        candidates.append(written(_pairs_in(_rooted(light, roots, s) if gained else light, s), "pairs"))
        heavy = heavy.drop("m", "led")
        rows = written(_apart(_rooted(heavy, roots, s) if gained else heavy), "apart")
        if not rows.take(1):
            break
        rows, split = _split(rows, s)
        candidates.append(written(_brief_pairs(rows, s), "pairs"))
        rows = written(_mixed(split), "sized")
        released(spark)
    every = written(reduce(DataFrame.union, candidates).distinct(), "candidates")
    for table in candidates:
        dropped(table)
    released(spark)
    # first one pair for each class, then those whose ends are not connected
    known = linked(written(every.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs"), texts, s)
    roots = components(known if likes is None else known.union(likes))
    ends = [_small(roots.select(F.col("id").alias(side), F.col("root").alias(f"r{side}")), 32, s) for side in ("a", "b")]
    apart = every.join(ends[0], "a", "left").join(ends[1], "b", "left")
    apart = apart.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    return roots.select(F.col("id").alias("a"), F.col("root").alias("b")).union(linked(written(apart, "pairs"), texts, s))


SALTS = 16
TASK_MET = 1 << 16  #: pairs of a bucket that a task holds against the sieve, before the bucket is dealt to more
TASK_PAIRS = 1000  #: compared by a task


def dropped_lines(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, mark, gone): the numbers of the lines that go, for the texts that lose any.

    Written; each other table goes as soon as nothing reads it, those of texts first.
    """
    spark = docs.sparkSession
    lines = packed(hashed_lines(docs, s), "lines")
    place = F.struct("doc_id", "line", "mark")
    classes = lines.groupBy("h1").agg(F.min(place).alias("at"), F.first("sketch").alias("sketch"), F.first("chars").alias("chars"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes.select(F.col("h1").alias("id"), "sketch", "chars", "copies", "at.doc_id", "at.line", "at.mark"), "classes")
    released(spark)
    rows, met = met_classes(classes, s)
    texts = texts_of(met, lines, s)
    places = written(lines.select("h1", "doc_id", "mark", "line"), "places")
    dropped(lines)
    released(spark)
    roots = components(links_of(rows, met, texts, s))
    for table in (rows, met, texts):
        dropped(table)
    released(spark)
    grouped = classes.drop("sketch", "chars").join(roots, "id", "left").where("copies > 1 or root is not null").withColumn("root", F.coalesce("root", "id"))
    grouped = written(grouped.select("id", "root", "doc_id", "line", "mark"), "grouped")
    dropped(classes)
    # one group may hold very many classes: its first place goes to each of its salts
    kept = grouped.groupBy("root").agg(F.min(place).alias("keep")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    decided = grouped.select("id", "root", F.pmod("id", F.lit(SALTS)).cast("int").alias("salt")).join(kept, ["root", "salt"])
    decided = decided.select(F.col("id").alias("h1"), "keep")
    gone = places.join(decided, "h1").where(~place.eqNullSafe(F.col("keep"))).select("doc_id", "mark", "line").distinct()
    gone = written(gone.groupBy("doc_id", "mark").agg(F.collect_list("line").alias("gone")), "gone")
    for table in (places, grouped):
        dropped(table)
    released(spark)
    return gone


def dedup_lines(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The rows of ``docs`` with the text that stays, and the numbers of lines before and of lines that went (``n_lines``, ``n_gone`` with underscores before them where such columns exist)."""
    s = settings or Settings()
    free = "_" * (1 + max(len(c) for c in docs.columns))
    key, mark, gone = f"{free}id", f"{free}mark", f"{free}gone"
    out = docs.withColumn(key, F.col("doc_id").cast("long")).withColumn(mark, F.xxhash64("text"))
    drops = dropped_lines(docs, s).select(F.col("doc_id").alias(f"{key}2"), F.col("mark").alias(f"{mark}2"), F.col("gone").alias(gone))
    out = out.join(drops, F.col(key).eqNullSafe(F.col(f"{key}2")) & (F.col(mark) == F.col(f"{mark}2")), "left")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col(gone), i)), "\n"))
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n")))
    names = {c: c if c not in docs.columns else f"{free}{c}" for c in ("n_lines", "n_gone")}
    return out.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns], n_lines.cast("long").alias(names["n_lines"]), F.coalesce(F.size(F.col(gone)), F.lit(0)).cast("long").alias(names["n_gone"]))


def op6_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op6_fuzzy_line_dedup": op6_fuzzy_line_dedup}
