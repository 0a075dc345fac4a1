"""Fuzzy line dedup with DataFrame functions alone.

Lines (parts of a text between line feeds) are normalised: lower case, runs of anything but letters, their marks and
digits to single spaces, digits to 0 (not where a line has no letters: rows of numbers differ in nothing else). Lines of
at least MIN_WORDS words or MIN_CHARS characters count. Equal normalised lines are one distinct line; those under
MIN_WORDS words are linked to no others. Two other distinct lines are linked if they share a block key, their SimHashes
differ in at most RADIUS of 62 bits and their edit similarity ``1 - distance / longer length``, in words, is at least SIMILARITY.
Of every connected group the first occurrence, by (doc_id, text, line number), stays; all others are removed.

Pigeonhole blocks. Blocks of a SimHash's bits can't find lines of such similarity: one changed word in twenty moves some
seven of 64 bits, anywhere, so that keys of bits that stay are either too short to tell lines apart or too many. The
blocks are therefore cut before the projection: a line's distinct words are dealt by hash to a ring of BLOCKS blocks, and
each block is the sum of its words' hashes, so that a changed word spoils one block or two and leaves the others as they
are. A key is the sum of a run of 1, 2, 4, 8 or all blocks, the shortest with LEAST words; runs start at every second
block, in lines of under SHORT words at every one. Lines of 256 distinct words or more use the half, quarter ... of their words that a
hash chooses, so that a block has 8 to 16 words whatever the line's length; lines near a limit of two such classes take
part in both.

SimHash. Only lines that share a key with another are hashed: a bit is set if it is set in over half of the hashes of the
line's distinct words, counted in 31 bits, which a line can't exceed.

Crowded keys: the members of a key are compared with the key's first member alone, which is linear. Members that
this leaves in different groups are then compared with one another, so no link between groups is lost, while links
inside a group, which change nothing, are never listed.

Distances are measured on strings with one character for each word, chosen by hash out of LETTERS. Near lines of over LONG
words are settled by an upper bound of their distance, from one walk over their words, if that is within the limit.

Nulls: a null text has no lines and stays null; a null doc_id ranks first. Rows that agree in doc_id and text are one
document. Texts without a line that counts come back as they are. Other columns are kept by ``remove_lines``.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages, clean_columns, sendable, staged, table
from .components import connected_components

MIN_WORDS, RADIUS, SIMILARITY = 5, 18, 0.8
#: Normalised lines of so many characters count whatever their words: scripts without spaces, and short lines of boilerplate.
MIN_CHARS = 10
#: Blocks of the ring, words that a key has at least (in lines of so many distinct words), and lines whose runs start at every block.
BLOCKS, LEAST, LEAST_FEW, FEW, SHORT = 16, 4, 3, 12, 24
#: Lines of twice as many distinct words or more use a sample of their words; within OVERLAP of a limit, both classes' samples.
SAMPLE, OVERLAP = 128, 1.2
#: Bits of a word's hash in a block's sum, whose low bits count its words.
VALUE, COUNT = 45, 9
#: Characters that stand for words, from the first on (none of them combine or are surrogates).
FIRST_LETTER, LETTERS = 0x4E00, 20_000
LONG = 2048
#: Bits of a lane in which bits of the hashes of a line's words are counted, if they are few enough for it.
NARROW = 9
#: Words of the pieces in which lines are compared first.
PIECE = 32


def normalised(line: Column) -> Column:
    plain = F.regexp_replace(F.lower(line), r"[^\p{L}\p{M}\p{N}]+", " ")
    # Most lines have no digits: looking for one is cheaper than writing the line anew.
    return F.trim(F.when(plain.rlike(r"\p{Nd}") & line.rlike(r"\p{L}"), F.regexp_replace(plain, r"\p{Nd}", "0")).otherwise(plain))


def _key() -> Column:
    return F.xxhash64("text")


def _levels(n: Column) -> Column:
    """By which powers of two a line's words are thinned; the first is the line's own class."""
    top = F.greatest(F.floor(F.log2(n / SAMPLE)), F.lit(0)).cast("int")
    lower = (top > 0) & (n < OVERLAP * SAMPLE * F.pow(F.lit(2.0), top))
    return F.when(lower, F.array(top, top - 1)).otherwise(F.array(top))


def _block_keys(rows: DataFrame, *kept: str) -> DataFrame:
    """``keys`` of each row with the blocks' sums ``b0`` ... and ``n``, the number of distinct words."""
    ring = lambda name, i: F.col(f"{name}{i % BLOCKS}")
    rows = rows.select(*kept, "n", *[F.coalesce(f"b{i}", F.lit(0)).alias(f"r1_{i}") for i in range(BLOCKS)])
    widths = [1]
    while widths[-1] < BLOCKS:
        w = widths[-1]
        starts = range(BLOCKS) if 2 * w < BLOCKS else [0]
        rows = rows.select("*", *[(ring(f"r{w}_", i) + ring(f"r{w}_", i + w)).alias(f"r{2 * w}_{i}") for i in starts])
        widths.append(2 * w)
    least = F.when(F.col("n") < FEW, LEAST_FEW).otherwise(LEAST)
    low = F.lit((1 << COUNT) - 1).cast("long")
    keys = []
    for i in range(BLOCKS):
        key = F.col(f"r{BLOCKS}_0")
        for w in reversed(widths[:-1]):
            key = F.when(ring(f"r{w}_", i).bitwiseAND(low) >= least, ring(f"r{w}_", i)).otherwise(key)
        keys.append(F.when(F.col("n") < SHORT, key) if i % 2 else key)
    return rows.select(*kept, F.array_compact(F.array_distinct(F.array(*keys))).alias("keys"))


def occurrences(docs: DataFrame) -> DataFrame:
    """``oid, id, key, line, h1, h2, many, main, keys`` of each line that counts (rows that aren't ``main`` only bring more keys).

    ``many``: it has MIN_WORDS words. ``h1`` and ``h2`` identify the normalised line by 128 bits.
    """
    # Dealt by document, so that the words of a line add up where they are.
    dealt = docs.select(F.col("doc_id").alias("id"), _key().alias("key"), "text").repartition("id", "key")
    keyed = dealt.select("id", "key", F.posexplode(F.split("text", "\n", -1)).alias("line", "raw"))
    norm = keyed.select("id", "key", "line", normalised(F.col("raw")).alias("norm"))
    long = (F.length("norm") >= MIN_CHARS).alias("long")
    place = ["oid", "id", "key", "line", "h1", "h2"]
    norm = norm.select("id", "key", "line", F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2"), long, F.split("norm", " ").alias("w"))
    many = F.size("w") >= MIN_WORDS
    # The counter column is a barrier too: what is inferred from explode() isn't pushed below it.
    norm = norm.select(F.monotonically_increasing_id().alias("oid"), *place[1:], many.alias("many"), F.when(F.col("long") | many, F.array_distinct("w")).alias("w"))
    # Short lines explode to nothing. A filter would be pushed below and normalise every line a second time.
    levels = F.when(F.col("w").isNotNull(), _levels(F.size("w")))
    norm = norm.select(*place, "many", "w", F.size("w").alias("n"), F.posexplode(levels).alias("at", "level"))
    words = norm.select(*place, "many", "n", (F.col("at") == 0).alias("main"), "level", F.explode("w").alias("w"))
    words = words.select(*place, "many", "n", "main", "level", F.xxhash64("w").alias("h"))
    # Other words than the sampled ones belong to no block; they leave the row in place.
    block = F.when(F.shiftright("h", 4).bitwiseAND(F.expr("shiftleft(1L, level) - 1")) == 0, F.col("h").bitwiseAND(F.lit(BLOCKS - 1).cast("long")))
    value = F.shiftleft(F.shiftrightunsigned("h", 64 - VALUE), COUNT) + 1
    words = words.select(*place, "many", "n", "main", block.alias("block"), value.alias("value"))
    sums = [F.sum(F.when(F.col("block") == i, F.col("value"))).alias(f"b{i}") for i in range(BLOCKS)]
    return _block_keys(words.groupBy(*place, "many", "n", "main").agg(*sums), *place, "many", "main")


def _majorities(words: DataFrame, width: int) -> DataFrame:
    """``lid, sim, n`` of ``words`` (``lid, n, h``): each sum counts bits of the hashes in lanes of ``width`` bits, the highest of which stays free."""
    pick = F.lit(sum(1 << k for k in range(0, 64 - width, width))).cast("long")
    sums = words.groupBy("lid", "n").agg(F.count("*").alias("d"), *[F.sum(F.shiftrightunsigned("h", j).bitwiseAND(pick)).alias(f"s{j}") for j in range(width)])
    # The free bit of a lane is set by this if its count is over half.
    more = pick * (F.lit(1 << (width - 1)).cast("long") - F.shiftright("d", 1) - 1)
    sim = F.lit(0).cast("long")
    for j in range(width):
        sim = sim.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col(f"s{j}") + more, width - 1).bitwiseAND(pick), j))
    return sums.select("lid", "n", sim.bitwiseAND(F.lit((1 << 62) - 1).cast("long")).alias("sim"))


def simhash(rows: DataFrame) -> DataFrame:
    """``lid, sim, n`` of rows with ``lid, norm``: 62 bits over the distinct words, and the number of all words."""
    words = rows.select("lid", F.split("norm", " ").alias("w")).select("lid", F.size("w").alias("n"), F.array_distinct(F.transform("w", lambda w: F.xxhash64(F.lit(2), w))).alias("w"))
    hashes = lambda x: x.select("lid", "n", F.explode("w").alias("h"))
    few = F.size("w") < 1 << (NARROW - 1)
    out = _majorities(hashes(words.where(few)), NARROW).union(_majorities(hashes(words.where(~few)), 31))
    return out.select("lid", "n", "sim")


def coded(norm: Column) -> Column:
    """A line with one character for each of its words, by hash: what distances in words are measured on."""
    letter = lambda w: F.hex(F.lit(FIRST_LETTER).cast("long") + F.pmod(F.xxhash64(F.lit(3), w), F.lit(LETTERS).cast("long")))
    return F.decode(F.unhex(F.array_join(F.transform(F.split(norm, " "), letter), "")), "UTF-16BE")


def _alignment(a: Column, b: Column) -> Column:
    """An upper bound of the distance of two arrays: what one walk over ``a`` finds that meets each change with the first
    of these that puts the arrays in step again: one element for another, one more, one less."""
    state = lambda shift, cost: F.struct(shift.cast("int").alias("shift"), cost.cast("long").alias("cost"))

    def step(s: Column, i: Column) -> Column:
        j = i + s["shift"]
        x, y, x1, y1 = F.get(a, i), F.get(b, j), F.get(a, i + 1), F.get(b, j + 1)
        swap, more, less = (state(s["shift"] + k, s["cost"] + 1) for k in (0, 1, -1))
        return F.when(x == y, s).when(x1 == y1, swap).when(x == y1, more).when(x1 == y, less).otherwise(swap)

    rest = lambda s: s["cost"] + F.greatest(F.size(b) - F.size(a) - s["shift"], F.lit(0))
    return F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), state(F.lit(0), F.lit(0)), step, rest)


def _by_pieces(a: str, b: str, most: str) -> Column:
    """An upper bound of the distance of two texts: the sum over pieces at equal places, as far as it stays within ``most``. A word more
    or less costs two in each later piece, so that near lines are known by it; a walk over whole texts takes the square of their length."""
    piece = lambda x, k: F.substring(F.col(x), k * PIECE + 1, F.lit(PIECE))
    apart = lambda x, y: F.when(x == y, 0).otherwise(F.levenshtein(x, y))
    last = F.floor(F.greatest(F.length(a), F.length(b)) / PIECE).cast("int")
    return F.aggregate(F.sequence(F.lit(0), last), F.lit(0), lambda t, k: F.when(t > F.col(most), t).otherwise(t + apart(piece(a, k), piece(b, k))))


def _most(a: str, b: str, similarity: float) -> Column:
    """The greatest distance that lines of so many words may have."""
    return F.floor(F.greatest(a, b) * F.lit(1 - similarity) + F.lit(1e-9)).cast("int")


def _close(x: str, y: str, radius: int, similarity: float) -> Column:
    near = F.bit_count(F.col(f"s{x}").bitwiseXOR(F.col(f"s{y}"))) <= radius
    return near & (F.abs(F.col(f"n{x}") - F.col(f"n{y}")) <= _most(f"n{x}", f"n{y}", similarity))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) that are similar enough, as ``u``, ``v``."""
    side = lambda x: texts.select(F.col("lid").alias(x), F.col("code").alias(f"t{x}"), F.length("code").alias(f"n{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    long = F.greatest("na", "nb") > LONG
    letters = [F.when(long, F.split(f"t{x}", "")).alias(f"w{x}") for x in "ab"]
    # The counter column is a barrier: a filter pushed below it would split both texts again for every word.
    both = both.select("a", "b", long.alias("long"), _most("na", "nb", similarity).alias("most"), "ta", "tb", *letters, F.monotonically_increasing_id().alias("barrier"))
    near = F.when(F.col("long") & (_alignment(F.col("wa"), F.col("wb")) <= F.col("most")), True).otherwise(F.expr("levenshtein(ta, tb, most) >= 0"))
    # Each word that one line alone has costs one at least.
    alone = lambda x, y: F.size(F.array_except(F.split(x, ""), F.split(y, "")))
    both = both.where((alone("ta", "tb") <= F.col("most")) & (alone("tb", "ta") <= F.col("most")))
    return both.where((_by_pieces("ta", "tb", "most") <= F.col("most")) | near).select(F.col("a").alias("u"), F.col("b").alias("v"))


def line_texts(occ: DataFrame, wanted: DataFrame, docs: DataFrame, work: Stages) -> DataFrame:
    """``lid, norm, code`` of the lines in ``wanted`` (``lid``, staged), read at their places."""
    at = occ.where("main").select(F.col("oid").alias("lid"), "id", "key", "line").join(sendable(wanted, 16), "lid")
    spots = work.staged(at.groupBy("id", "key").agg(F.collect_list(F.struct("lid", "line")).alias("spots")), "line-spots")
    spots = sendable(spots, 64, 16 * wanted.count())
    texts = docs.select("doc_id", _key().alias("text_key"), "text").join(spots, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")))
    # The same document may stand there more than once.
    texts = texts.select("spots", F.split("text", "\n", -1).alias("parts"))
    found = texts.select(F.explode(F.transform("spots", lambda s: F.struct(s["lid"].alias("lid"), F.get("parts", s["line"]).alias("raw")))).alias("x"))
    return found.select("x.lid", normalised(F.col("x.raw")).alias("norm")).dropDuplicates(["lid"]).select("lid", "norm", coded(F.col("norm")).alias("code"))


def line_links(occ: DataFrame, lines: DataFrame, docs: DataFrame, work: Stages, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """Links ``u``, ``v`` (``lid``) that connect the groups of near lines."""
    repeats = sendable(work.staged(lines.where("c > 1").select("h1", "h2", "lid"), "line-repeats"), 40)
    again = occ.where("main and many").join(repeats, ["h1", "h2"]).where("oid <> lid").select("oid")
    again = sendable(work.staged(again, "line-again"), 16)
    keyed = occ.where("many").select("oid", "keys").join(again, "oid", "left_anti").select(F.col("oid").alias("lid"), F.explode("keys").alias("k"))
    # Most keys have one line: the keys alone are counted first.
    shared = keyed.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k", (F.col("c") > 2).alias("crowded"))
    shared = sendable(work.staged(shared, "line-keys"), 24)
    members = work.staged(keyed.join(shared, "k").distinct(), "line-members")
    wanted = work.staged(members.select("lid").distinct(), "line-wanted")
    texts = work.staged(line_texts(occ, wanted, docs, work), "line-texts")
    sims = work.staged(simhash(texts), "line-sims")
    side = lambda x: sims.select(F.col("lid").alias(x), F.col("sim").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
    ends = work.staged(members.groupBy("k", "crowded").agg(F.min("lid").alias("a"), F.max("lid").alias("b")).where("a < b"), "line-ends")
    leader = sendable(work.staged(ends.where("crowded").select("k", "a"), "line-leaders"), 24)
    led = work.staged(members.where("crowded").select("k", "lid").join(leader, "k").where("lid <> a").select("k", "a", F.col("lid").alias("b")), "line-led")
    pairs = ends.where("not crowded").select("a", "b").union(led.select("a", "b")).distinct()
    pairs = work.staged(pairs.join(side("a"), "a").join(side("b"), "b").where(_close("a", "b", radius, similarity)).select("a", "b"), "line-pairs")
    first = work.staged(_verified(pairs, texts, similarity), "line-links")
    roots = work.hold(connected_components(first)).withColumnRenamed("node", "lid")
    placed = work.staged(led.select("k", F.col("b").alias("lid")).join(roots, "lid", "left").select("k", "lid", F.coalesce("root", "lid").alias("root")), "line-placed")
    split = placed.groupBy("k").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("k")
    open_ = work.staged(placed.join(split, "k"), "line-open")
    mine = open_.select("k", F.col("lid").alias("a"), F.col("root").alias("ra")).join(side("a"), "a")
    other = open_.select("k", F.col("lid").alias("b"), F.col("root").alias("rb")).join(side("b"), "b")
    rest = mine.join(other, "k").where((F.col("ra") < F.col("rb")) & _close("a", "b", radius, similarity))
    rest = work.staged(rest.select("a", "b").distinct(), "line-rest")
    return first if rest.isEmpty() else first.union(work.staged(_verified(rest, texts, similarity), "line-links"))


def repeated_lines(docs: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """``id, key, gone`` (staged): the numbers of the lines to remove from each document that has any."""
    work = Stages()
    occ = work.staged(occurrences(docs), "line-occurrences")
    lines = work.staged(occ.where("main").groupBy("h1", "h2").agg(F.min("oid").alias("lid"), F.count("*").alias("c")), "line-distinct")
    links = line_links(occ, lines, docs, work, radius, similarity)
    roots = work.hold(connected_components(links)).withColumnRenamed("node", "lid")
    known = lines.join(roots, "lid", "left").where("root is not null or c > 1").select("h1", "h2", F.coalesce("root", "lid").alias("root"))
    known = sendable(work.staged(known, "line-groups"), 40)
    place = F.struct("id", "key", "line")
    held = work.staged(occ.where("main").select("id", "key", "line", "h1", "h2").join(known, ["h1", "h2"]).select("id", "key", "line", "root"), "line-held")
    first = sendable(work.staged(held.groupBy("root").agg(F.min(place).alias("kept")), "line-kept"), 48)
    gone = held.join(first, "root").where(~place.eqNullSafe(F.col("kept")))
    out = staged(gone.groupBy("id", "key").agg(F.collect_set("line").alias("gone")), "line-gone")
    work.drop()
    return out


def remove_lines(docs: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the repeated lines in ``text``, and ``__gone``, the sorted numbers of those lines (or null)."""
    gone = repeated_lines(clean_columns(docs, "doc_id", "text"), radius, similarity)
    lines = gone.agg(F.sum(F.size("gone"))).first()[0] or 0
    marks = sendable(gone.select(F.col("id").alias("__id"), F.col("key").alias("__key"), F.array_sort("gone").alias("__gone")), 64, 4 * lines)
    joined = docs.join(marks, F.col("doc_id").eqNullSafe(F.col("__id")) & (_key() == F.col("__key")), "left")
    # Cut once, in a column of its own: inside a lambda the text would be cut anew for every line.
    joined = joined.withColumn("__parts", F.when(F.col("__gone").isNotNull(), F.split("text", "\n", -1)))
    left = F.array_except(F.sequence(F.lit(0), F.size("__parts") - 1), "__gone")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("__parts", i)), "\n"))
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], "__gone")


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_lines(clean_columns(table(spark, sf_dir, "documents"), "doc_id", "text"))
    n = F.coalesce(F.size("__gone"), F.lit(0)).cast("long")
    return out.select("doc_id", "text", n.alias("n_removed"), F.col("__gone").alias("removed_lines"))
