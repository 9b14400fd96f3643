"""Removing lines that nearly repeat, by SimHash, pigeonhole blocks and edit similarity; DataFrame operations only.

A line is normalised to its lower-cased words of letters and digits. Equal normalised lines are a class, whose first
occurrence is the least (doc_id, hash of the text, line number). The distinct words of a line are dealt by their hashes
into blocks, more of them the more words there are; two lines that differ in fewer words than there are blocks have a
block in common. A block is its words in the order of their hashes, and a block of few words is filled up with the next
ones in that order, so a block of frequent words alone says enough to be a key. Blocks of the bits of one SimHash, which
an edit touches all over, found 0.3 to 0.8 of the similar pairs; blocks of the words that vote find 0.97 of them. Classes that
share a block are candidates if their SimHashes differ in APART bits at most; they are linked if their edit similarity,
1 - distance / longer length over the normalised lines, is 0.8 or more.

In a block's bucket every class is first compared with the bucket's least. Then, wherever a bucket still holds
different components, the classes outside its least's component are compared with all of other components. So a bucket
of near copies costs a comparison for each, and no candidates stay undecided. Of all lines of a connected group the
first occurrence stays.

Lines end with a line feed. Lines without letters and digits always stay, and so do a null text and a null doc_id's
place in the order: null ids come first. Rows that agree in doc_id and text are one document, and keep the same lines.
Lines of any length are compared. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, join_frequent, written

#: Blocks of a line by its least number of words, and how far that may be off: there, lines have the blocks of both sides.
LEVELS = ((0, 4), (20, 10), (120, 24))
SLACK = 1.15
#: Words of a block at least, and most differing bits of candidates' SimHashes.
FULL, APART = 4, 16
#: Words of which lanes of 8 and of 16 bits hold the votes; the highest lane holds a sign too. More take lanes of 32.
FEW, LONGEST = 127, 30_000


def line_words(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), "")


def cuts(blocks: int) -> list[int]:
    """The least hashes of all blocks but the first."""
    return [(i << 64) // blocks - (1 << 63) for i in range(1, blocks)]


def _places(ordered: str, sought: Column) -> Column:
    return F.transform(sought, lambda c, i: F.array_position(ordered, c).cast("int") - (i + 1))


def _hashed(starts: str, blocks: int, size: Column) -> Column:
    def key(first: Column, i: Column) -> Column:
        count = F.get(starts, i + 1) - first
        words = F.slice("_around", first + 1, F.greatest(count, F.least(F.lit(FULL), size)))
        return F.when(count > 0, F.xxhash64(F.lit(blocks), i, words))

    return F.transform(starts, key)


def with_keys(lines: DataFrame) -> DataFrame:
    """lines(words, ...) with keys: a hash of each of a line's blocks, of FULL words at least where the line has so many;
    null for an empty block. Step by step, so that each array is made once."""
    own = lines.columns
    n, size, none = F.size("words"), F.size("_hashes"), F.array().cast("array<bigint>")
    lines = lines.withColumn("_hashes", F.sort_array(F.array_distinct(F.transform("words", lambda w: F.xxhash64(w)))))
    ends = [low for low, _ in LEVELS[1:]] + [None]
    ordered, starts, keys = {}, {}, []
    for (low, blocks), end in zip(LEVELS, ends, strict=True):
        o, s = f"_o{blocks}", f"_s{blocks}"
        here = (n * SLACK >= low) if end is None else (n * SLACK >= low) & (n < end * SLACK)
        sought = F.array(*(F.lit(c).cast("long") for c in cuts(blocks)))
        ordered[o] = F.when(here, F.sort_array(F.concat("_hashes", sought)))  # a cut's place tells how many hashes are below it
        starts[s] = F.when(F.col(o).isNotNull(), F.concat(F.array(F.lit(0)), _places(o, sought), F.array(size)))
        keys.append(F.coalesce(_hashed(s, blocks, size), none))
    lines = lines.withColumns(ordered | {"_around": F.concat("_hashes", F.slice("_hashes", 1, FULL))}).withColumns(starts)
    return lines.select(*own, F.concat(*keys).alias("keys"))


def simhash(words: Column) -> Column:
    """64 bits, each what most of the distinct words' hashes have there (0 in a draw).

    A sum counts the votes on several bits at once: on eight, in lanes of a byte, for up to FEW words, on four for
    up to LONGEST, on two for more.
    """
    votes = F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))

    def summed(votes: Column, lanes: int) -> Column:
        ones = F.lit(sum(1 << (64 // lanes * k) for k in range(lanes))).cast("long")

        def count(i: int) -> Column:
            return F.aggregate(votes, F.lit(0).cast("long"), lambda a, h: a + F.shiftrightunsigned(h, i).bitwiseAND(ones))

        return F.array(*(count(i) for i in range(64 // lanes)))

    def elected(sums: Column, n: Column, lanes: int) -> Column:
        step, full = 64 // lanes, F.lit((1 << 64 // lanes) - 1).cast("long")
        bits = F.lit(0).cast("long")
        for i in range(64):
            won = F.shiftrightunsigned(F.get(sums, F.lit(i % step)), i - i % step).bitwiseAND(full) * 2 > n
            bits = bits.bitwiseOR(F.when(won, F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")))
        return bits

    def of(votes: Column) -> Column:
        n = F.size(votes)
        few, many, most = (_let(summed(votes, lanes), lambda sums, lanes=lanes: elected(sums, n, lanes)) for lanes in (8, 4, 2))
        return F.when(n <= FEW, few).when(n <= LONGEST, many).otherwise(most)

    return _let(votes, of)


def _let(value: Column, of) -> Column:
    """of(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), lambda x: of(x)), F.lit(0))


def _close(pairs: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose lengths and SimHashes let them be candidates; known has id, sim and size."""
    met = pairs.join(known.select(F.col("id").alias("a"), F.col("sim").alias("sim_a"), F.col("size").alias("size_a")), "a")
    met = met.join(known.select(F.col("id").alias("b"), F.col("sim").alias("sim_b"), F.col("size").alias("size_b")), "b")
    return met.where(_may_link(least)).select("a", "b")


def _may_link(least: float) -> Column:
    longer, shorter = F.greatest("size_a", "size_b"), F.least("size_a", "size_b")
    return (longer - shorter <= _most(longer, least)) & (F.bit_count(F.col("sim_a").bitwiseXOR(F.col("sim_b"))) <= APART)


def _most(longer: Column, least: float) -> Column:
    return F.floor((1 - F.lit(least)) * longer + 1e-9).cast("int")


def _confirmed(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of classes that are similar.

    Edits of k words are k * (widest + 1) edits of characters at most, so few edits of the signs show that a pair is
    similar, in a fraction of the time; two are allowed for words that share a sign. All other pairs are compared by
    their characters, in bands that widen, as a comparison takes the time of its band's width.
    """
    left, right = (texts.select(*(F.col(c).alias(f"{c}_{side}") for c in ("id", "text", "signs", "widest"))) for side in "ab")
    met = pairs.join(left, F.col("a") == F.col("id_a")).join(right, F.col("b") == F.col("id_b"))
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(tasks, "a", "b")  # few bytes and much work, which would else be put together into few tasks
    met = met.withColumn("most", _most(F.greatest(F.char_length("text_a"), F.char_length("text_b")), least))
    met = met.withColumn("words", F.floor(F.col("most") / (F.greatest("widest_a", "widest_b") + 1)).cast("int") - 2)
    by_words = "words > 0 and levenshtein(signs_a, signs_b, greatest(words, 0)) >= 0"
    by_letters = (f"levenshtein(text_a, text_b, cast(most / {n} as int)) >= 0" for n in (16, 4, 1))
    return met.where(F.expr(" or ".join([by_words, *by_letters]))).select("a", "b")


def _texts(docs: DataFrame, ids: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, text, sim, size, signs, widest) of the classes in ids(id), from their first lines: signs has a character for
    each word, and widest is the longest word's length."""
    needed = ids.join(classes.select("id", "first.*"), "id")
    of_doc = needed.groupBy("doc_id", "key").agg(F.collect_set(F.struct("line", "id")).alias("wanted"))
    whole = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("k"), "text")
    met = whole.join(of_doc, whole.d.eqNullSafe(of_doc.doc_id) & (whole.k == of_doc.key))
    raw = met.select(F.split("text", "\n").alias("raw"), "wanted").select("raw", F.explode("wanted").alias("w"))
    # a document that comes twice gives its lines twice; lines travel once more for that, whole texts don't
    lines = raw.select("w.id", F.get("raw", F.col("w.line")).alias("line")).dropDuplicates(["id"])
    words = lines.select("id", line_words(F.col("line")).alias("words"))
    sign = F.array_join(F.transform("words", _sign), "").alias("signs")
    widest = F.array_max(F.transform("words", lambda w: F.char_length(w))).alias("widest")
    rows = words.select("id", F.array_join("words", " ").alias("text"), simhash(F.col("words")).alias("sim"), sign, widest)
    return rows.withColumn("size", F.char_length("text"))


def _sign(word: Column) -> Column:
    """One of 20,992 characters for a word."""
    return F.decode(F.unhex(F.hex(F.pmod(F.xxhash64(word), F.lit(0x5200)) + 0x4E00)), "UTF-16BE")


def line_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (doc_id, key, line, h1, h2) and their classes (id, h1, h2, first, many, keys), both written."""
    # words are made before the lines are told apart: a filter on them would make them twice
    known = docs.select("doc_id", F.xxhash64("text").alias("key"), F.posexplode(F.transform(F.split("text", "\n"), line_words)).alias("line", "words"))
    words = known.where(F.size("words") > 0)
    lines = with_keys(words).select("doc_id", "key", "line", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), F.col("words")).alias("h2"), "keys")
    keyed = written(lines, "lines-keys")
    grouped = keyed.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "key", "line")).alias("first"), F.count("*").alias("many"), F.first("keys").alias("keys"))
    classes = written(grouped.withColumn("id", F.monotonically_increasing_id()), "lines-classes")
    lines = written(keyed.drop("keys"), "lines")
    discard(keyed)
    return lines, classes


def linked(docs: DataFrame, classes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(node, component) of the classes that have links, and the classes without keys; the classes as they came are deleted."""
    keyed = classes.where("id is not null").select("id", F.explode("keys").alias("bucket")).where("bucket is not null").repartition("bucket")
    shared = keyed.groupBy("bucket").agg(F.min("id").alias("least"), F.count("*").alias("members")).where("members > 1")
    members = written(keyed.join(shared, "bucket").select("bucket", "id", "least"), "lines-buckets")
    keyless = written(classes.drop("keys"), "lines-classes")
    discard(classes)
    classes = keyless
    texts = written(_texts(docs, members.select("id").distinct(), classes), "lines-texts")
    known = texts.select("id", "sim", "size")
    star = members.where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")).distinct()
    links = written(_confirmed(_close(star, known, least), texts, least), "lines-links")
    so_far = components(links.toDF("u", "v"), "lines-components")
    rows = members.join(so_far, members.id == so_far.node, "left").select("bucket", "id", F.coalesce("component", "id").alias("of"), "least")
    rows = regions = written(rows, "lines-regions")
    parted = rows.groupBy("bucket").agg(F.min("of").alias("low"), F.max("of").alias("high"), F.max(F.when(F.col("id") == F.col("least"), F.col("of"))).alias("main"))
    rows = rows.drop("least").join(parted.where("low <> high").select("bucket", "main"), "bucket").join(known, "id")
    strays = rows.where("of <> main").select("bucket", F.col("id").alias("a"), F.col("of").alias("of_a"), F.col("sim").alias("sim_a"), F.col("size").alias("size_a"))
    others = rows.select("bucket", F.col("id").alias("b"), F.col("of").alias("of_b"), "main", F.col("sim").alias("sim_b"), F.col("size").alias("size_b"))
    undecided = (F.col("of_a") != F.col("of_b")) & ((F.col("of_b") == F.col("main")) | (F.col("a") > F.col("b"))) & _may_link(least)
    rest = strays.join(others, "bucket").where(undecided).select("a", "b").distinct().join(star, ["a", "b"], "left_anti")
    edges = links.unionAll(_confirmed(rest, texts, least)).toDF("u", "v")
    found = written(components(edges, "lines-components"), "lines-groups")
    for table in (members, texts, links, regions):
        discard(table)
    return found, classes


def removals(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, key, gone): of each document that loses lines, their numbers from 0; key is xxhash64(text)."""
    lines, classes = line_classes(docs)
    groups, classes = linked(docs, classes, least)
    firsts = classes.select("id", "h1", "h2", "first", "many").join(groups, classes.id == groups.node, "left")
    stays = firsts.where("component is not null").groupBy("component").agg(F.min(F.struct("first", "id")).alias("s")).select(F.col("s.id").alias("stay"))
    firsts = firsts.join(stays, firsts.id == stays.stay, "left").withColumn("lost", F.col("component").isNotNull() & F.col("stay").isNull())
    thin = firsts.where("lost or many > 1").select("h1", "h2", F.when(~F.col("lost"), F.col("first")).alias("first"), "many")
    place = F.struct("doc_id", "key", "line")
    gone = join_frequent(lines, thin, ["h1", "h2"], lines.count()).where(F.col("first").isNull() | (place != F.col("first")))
    return gone.groupBy("doc_id", "key").agg(F.collect_set("line").alias("gone"))


def deduplicated(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """docs(doc_id, text, ...) with the lines that stay in text, and columns n_lines and n_removed."""
    gone = removals(docs, least).toDF("_d", "_k", "_gone")
    met = docs.join(gone, docs.doc_id.eqNullSafe(gone._d) & (F.xxhash64(docs.text) == gone._k), "left")
    lines = F.split(docs.text, "\n")
    kept = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains("_gone", i)), "\n")
    removed = F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone"))
    text = F.when(F.col("_gone").isNull(), docs.text).otherwise(kept)
    return met.select(*(text.alias(c) if c == "text" else docs[c] for c in docs.columns), F.when(docs.text.isNull(), 0).otherwise(F.size(lines)).alias("n_lines"), removed.alias("n_removed"))
