"""Queries of the engine by name, with the SQL that checks them.

Sequences are the users' event codes, vectors the embeddings, strings the parts' names and the documents' letters. Rows
are long and scalar; doubles are rounded, as engines add up in different orders. Where it can, the SQL takes another way to the same
values: closed forms over joins of positions instead of folds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alphabet, blocks, distances, hashing, kmers, maths
from ..operators import flatten, hashed, merging, ordered, pairs, phases, phylogeny, ranges, sliding, stats, synth, tensors
from ..sources import exons, fasta, results, tables
from ..sources.shared import new_path, written
from . import engine, experiment, timing, triangle

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

SIZE, K, DIM = 5, 3, 8
AFFINE = hashing.Affine(DIM, 7)
UNIFORM, MURMUR, CRC = hashing.Injection(DIM, SIZE**K, 7), hashing.Murmur3(DIM, 7), hashing.Crc32c(DIM, 7)
TABLES2 = hashing.TensorTables.drawn(SIZE, 2, DIM, 7)
TABLES3 = hashing.TensorTables.drawn(SIZE, 3, DIM, 7)
TABLES4 = hashing.TensorTables.drawn(SIZE, 4, DIM, 7)
WINDOW, STRIDE = 16, 8
FLAT = flatten.cauchy(6, 4 * DIM, 7)
SIGNS = flatten.random_signs(32, 4 * DIM, 7)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add


def _numbers(values) -> str:
    return "[" + ", ".join(map(str, values)) + "]"


def _place_table(name: str, t: hashing.TensorTables) -> str:
    rows = ", ".join(f"({p}, {c}, {t.hashes[p][c]}, {t.signs[p][c]})" for p in range(t.t) for c in range(t.size))
    return f"{name}(p, c, h, s) AS (VALUES {rows})"


EV = "ev AS (SELECT user_id AS seq_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS pos, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS c FROM events)"
KM = f"{EV}, km AS (SELECT a.seq_id, a.pos, CAST(a.c + 5 * b.c + 25 * d.c AS BIGINT) AS kmer FROM ev a JOIN ev b ON b.seq_id = a.seq_id AND b.pos = a.pos + 1 JOIN ev d ON d.seq_id = a.seq_id AND d.pos = a.pos + 2), oc AS (SELECT *, row_number() OVER (PARTITION BY seq_id, kmer ORDER BY pos) - 1 AS occ FROM km)"
FAM = "fam(idx, a, b) AS (VALUES " + ", ".join(f"({i}, CAST({AFFINE.a[i]} AS BIGINT), CAST({AFFINE.b[i]} AS BIGINT))" for i in range(DIM)) + ")"
MH = f"{KM}, {FAM}, mh AS (SELECT seq_id, idx, arg_min(kmer, (a * kmer + b) % 2147483647) AS kmer FROM km, fam GROUP BY seq_id, idx)"
WMH = f"{KM}, {FAM}, mh AS (SELECT seq_id, idx, arg_min(kmer, (a * (kmer + 125 * occ) + b) % 2147483647) AS kmer FROM oc, fam GROUP BY seq_id, idx)"
OMH = f"{KM}, {FAM}, lo AS (SELECT seq_id, idx, pos, kmer, row_number() OVER (PARTITION BY seq_id, idx ORDER BY (a * (kmer + 125 * occ) + b) % 2147483647, pos) AS r FROM oc, fam), mh AS (SELECT seq_id, idx, CAST(row_number() OVER (PARTITION BY seq_id, idx ORDER BY pos) - 1 AS INTEGER) AS place, kmer FROM lo WHERE r <= 3)"
LEN = "ln AS (SELECT seq_id, count(*) AS n FROM ev GROUP BY seq_id)"
STR = "st AS (SELECT seq_id, string_agg(chr(65 + c), '' ORDER BY pos) AS s FROM ev GROUP BY seq_id)"
VEC = "ve AS (SELECT vec_id AS seq_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings)"


def _sequences(spark: SparkSession, sf: str) -> DataFrame:
    return tables.event_sequences(spark, sf)


def _grams(spark: SparkSession, sf: str) -> DataFrame:
    return _sequences(spark, sf).withColumn("kmers", kmers.kmers(F.col("seq"), K, SIZE))


def _long(df: DataFrame, column: str, *keys: str, name: str = "value", digits: int | None = None) -> DataFrame:
    out = df.select(*keys, F.posexplode(column).alias("idx", name))
    return out.withColumn(name, F.round(name, digits) + F.lit(0.0)) if digits else out


@query(f"WITH {EV} SELECT seq_id, pos, c AS code FROM ev")
def encode_events(spark, sf):
    return _sequences(spark, sf).select("seq_id", F.posexplode("seq").alias("pos", "code"))


@query(f"WITH {KM} SELECT seq_id, pos, kmer FROM km")
def event_kmers(spark, sf):
    return kmers.exploded(_sequences(spark, sf), K, SIZE)


@query(f"WITH {KM} SELECT kmer, count(*) AS n, count(DISTINCT seq_id) AS sequences FROM km GROUP BY kmer")
def kmer_counts(spark, sf):
    return kmers.exploded(_sequences(spark, sf), K, SIZE).groupBy("kmer").agg(F.count("*").alias("n"), F.count_distinct("seq_id").alias("sequences"))


@query(f"WITH {KM} SELECT seq_id, pos, kmer, occ FROM oc")
def kmer_occurrences(spark, sf):
    return kmers.with_occurrence(kmers.exploded(_sequences(spark, sf), K, SIZE))


@query(f"WITH {MH} SELECT seq_id, idx, kmer FROM mh")
def minhash(spark, sf):
    return _long(_grams(spark, sf).select("seq_id", hashed.minhash(F.col("kmers"), AFFINE).alias("s")), "s", "seq_id", name="kmer")


@query(f"WITH {WMH} SELECT seq_id, idx, kmer FROM mh")
def weighted_minhash(spark, sf):
    return _long(_grams(spark, sf).select("seq_id", hashed.weighted_minhash(F.col("kmers"), AFFINE, SIZE**K).alias("s")), "s", "seq_id", name="kmer")


@query(f"WITH {OMH} SELECT seq_id, idx, place, kmer FROM mh")
def ordered_minhash(spark, sf):
    rows = _grams(spark, sf).select("seq_id", F.posexplode(hashed.ordered_minhash(F.col("kmers"), AFFINE, SIZE**K, 3)).alias("idx", "tuple"))
    return rows.select("seq_id", "idx", F.posexplode("tuple").alias("place", "kmer"))


@query(f"WITH {OMH} SELECT seq_id, idx, CAST(sum(kmer * CASE place WHEN 0 THEN 15625 WHEN 1 THEN 125 ELSE 1 END) AS BIGINT) AS packed FROM mh GROUP BY seq_id, idx")
def ordered_minhash_packed(spark, sf):
    tuples = hashed.ordered_minhash(F.col("kmers"), AFFINE, SIZE**K, 3)
    return _long(_grams(spark, sf).select("seq_id", hashed.packed(tuples, SIZE**K, 3).alias("s")), "s", "seq_id", name="packed")


@query(f"WITH {MH} SELECT x.seq_id AS i, y.seq_id AS j, CAST(count(*) FILTER (x.kmer <> y.kmer) AS INTEGER) AS dist, 1 - count(*) FILTER (x.kmer <> y.kmer) / 8.0 AS similarity FROM mh x JOIN mh y ON x.idx = y.idx AND y.seq_id < x.seq_id GROUP BY ALL")
def minhash_triangle(spark, sf):
    rows = _grams(spark, sf).select("seq_id", hashed.minhash(F.col("kmers"), AFFINE).alias("s"))
    met = pairs.compared(rows, "seq_id", "s", blocks.arrays, lambda a, b: [blocks.hamming(a, b)], "dist int")
    return met.select("i", "j", "dist", (1 - F.col("dist") / DIM).alias("similarity"))


@query(f"WITH {WMH} SELECT x.seq_id AS i, y.seq_id AS j, CAST(count(*) FILTER (x.kmer <> y.kmer) AS INTEGER) AS dist FROM mh x JOIN mh y ON x.idx = y.idx AND x.seq_id // 10 = y.seq_id // 10 AND x.seq_id < y.seq_id GROUP BY ALL")
def weighted_minhash_groups(spark, sf):
    rows = _grams(spark, sf).select("seq_id", pairs.group_of("seq_id", 10).alias("g"), hashed.weighted_minhash(F.col("kmers"), AFFINE, SIZE**K).alias("s"))
    return pairs.in_group(rows, "seq_id", "g", ["s"]).select("i", "j", distances.hamming(F.col("s_i"), F.col("s_j")).alias("dist"))


@query(f"WITH {OMH}, tu AS (SELECT seq_id, idx, list(kmer ORDER BY place) AS t FROM mh GROUP BY seq_id, idx) SELECT x.seq_id AS i, y.seq_id AS j, CAST(count(*) FILTER (x.t <> y.t) AS INTEGER) AS dist FROM tu x JOIN tu y ON x.idx = y.idx AND x.seq_id // 10 = y.seq_id // 10 AND x.seq_id < y.seq_id GROUP BY ALL")
def ordered_minhash_groups(spark, sf):
    rows = _grams(spark, sf).select("seq_id", pairs.group_of("seq_id", 10).alias("g"), hashed.ordered_minhash(F.col("kmers"), AFFINE, SIZE**K, 3).alias("s"))
    return pairs.in_group(rows, "seq_id", "g", ["s"]).select("i", "j", distances.hamming(F.col("s_i"), F.col("s_j")).alias("dist"))


def _chain(first: str, steps: list[tuple[str, str]], prefix: str) -> str:
    """CTEs that each add a column to the one before; the last is called like the prefix."""
    out = [f"{prefix}0 AS ({first})"]
    out += [f"{prefix}{i} AS (SELECT *, {expression} AS {name} FROM {prefix}{i - 1})" for i, (name, expression) in enumerate(steps, 1)]
    return ", ".join([*out, f"{prefix} AS (SELECT * FROM {prefix}{len(steps)})"])


def _injection_sql() -> str:
    """Key by key, a round's halves as columns."""
    a, b = UNIFORM.sides()
    assert a * b == UNIFORM.range
    numbers = ", ".join(f"({i}, {', '.join(f'CAST({x} AS BIGINT)' for r in UNIFORM.constants(i) for x in r)})" for i in range(DIM))
    names = ", ".join(f"f{r}, g{r}, u{r}, v{r}" for r in range(UNIFORM.ROUNDS))
    steps = []
    left, right = f"kmer % {a}", f"kmer // {a}"
    for r in range(UNIFORM.ROUNDS):
        half = lambda x, f, g: f"(({x}) * {f} + {g}) % {hashing.PRIME}"
        steps += [(f"y{r}", half(right, f"f{r}", f"g{r}")), (f"l{r}", f"({left} + y{r} * y{r} // 1024) % {a}")]
        steps += [(f"z{r}", half(f"l{r}", f"u{r}", f"v{r}")), (f"r{r}", f"({right} + z{r} * z{r} // 1024) % {b}")]
        left, right = f"l{r}", f"r{r}"
    return f"rc(idx, {names}) AS (VALUES {numbers}), " + _chain("SELECT DISTINCT kmer, rc.* FROM km, rc", [*steps, ("h", f"{right} * {a} + {left}")], "hv")


def _murmur_sql() -> str:
    """All four lanes of each pair of place and key, in HUGEINT."""
    word, m = "4294967296", hashing._LANES
    steps = []
    turn = lambda x, by: f"((({x}) << {by}) % {word} + (({x}) >> {32 - by}))"
    times = lambda x, c: f"(({x}) * {c}::HUGEINT % {word})::BIGINT"
    keys, h = ("CAST(idx AS BIGINT)", "0::BIGINT", f"kmer % {word}", f"kmer // {word}"), [f"{MURMUR.seed}::BIGINT"] * 4
    for i, key in enumerate(keys):
        own_turn, lane_turn, plus = hashing._TURNS[i]
        steps += [(f"p{i}", times(key, m[i])), (f"q{i}", times(turn(f"p{i}", own_turn), m[(i + 1) % 4])), (f"x{i}", f"xor({h[i]}, q{i})")]
        steps += [(f"h{i}", f"(({turn(f'x{i}', lane_turn)} + {h[(i + 1) % 4]}) % {word} * 5 + {plus}) % {word}")]
        h[i] = f"h{i}"
    steps += [(f"w{i}", f"xor(h{i}, 16::BIGINT)") for i in range(4)]
    steps += [("s0", f"(w0 + w1 + w2 + w3) % {word}")] + [(f"s{i}", f"(w{i} + s0) % {word}") for i in (1, 2, 3)]
    for i in range(4):
        steps += [(f"a{i}", times(f"xor(s{i}, s{i} >> 16)", hashing._LAST[0])), (f"b{i}", times(f"xor(a{i}, a{i} >> 13)", hashing._LAST[1])), (f"c{i}", f"xor(b{i}, b{i} >> 16)")]
    steps += [("e0", f"(c0 + c1 + c2 + c3) % {word}"), ("e1", f"(c1 + e0) % {word}"), ("h", f"e1::HUGEINT * {word} + e0 - 9223372036854775808::HUGEINT")]
    return _chain(f"SELECT DISTINCT kmer, i.idx FROM km, range({DIM}) i(idx)", steps, "hv")


def _crc_sql() -> str:
    """Byte by byte from either seed."""
    table, steps, state = f"{_numbers(hashing.CRC32C_TABLE)}::BIGINT[]", [], [f"{s}::BIGINT" for s in CRC.seeds()]
    for i in range(8):
        byte = f"(kmer >> {8 * i}) & 255" if i < 4 else f"(CAST(idx AS BIGINT) >> {8 * (i - 4)}) & 255"
        for n in (0, 1):
            steps.append((f"c{i}_{n}", f"xor({state[n]} >> 8, ({table})[1 + (xor({state[n]}, {byte}) & 255)])"))
            state[n] = f"c{i}_{n}"
    return _chain(f"SELECT DISTINCT kmer, i.idx FROM km, range({DIM}) i(idx)", [*steps, ("h", f"(({state[0]} << 4) & 4294967295) | {state[1]}")], "hv")


_HASH_COLUMNS = "SELECT kmer, CAST(idx AS INTEGER) AS idx, CAST(h AS BIGINT) AS hash FROM hv"
_MINHASH_COLUMNS = "SELECT seq_id, CAST(idx AS INTEGER) AS idx, arg_min(km.kmer, h) AS kmer FROM km JOIN hv USING (kmer) GROUP BY seq_id, idx"


def _hashed_kmers(spark, sf, family):
    keys = kmers.exploded(_sequences(spark, sf), K, SIZE).select("kmer").distinct()
    return _long(keys.select("kmer", F.array(*(family.hash(i, F.col("kmer")) for i in range(DIM))).alias("h")), "h", "kmer", name="hash")


def _minhash_of(spark, sf, family):
    """The few k-mers there can be are hashed once."""
    known = hashing.tabled(spark, family, SIZE**K)
    return _long(_grams(spark, sf).select("seq_id", hashed.minhash(F.col("kmers"), known).alias("s")), "s", "seq_id", name="kmer")


@query(f"WITH {KM}, {_injection_sql()} {_HASH_COLUMNS}")
def hash_uniform(spark, sf):
    return _hashed_kmers(spark, sf, UNIFORM)


@query(f"WITH {KM}, {_murmur_sql()} {_HASH_COLUMNS}")
def hash_murmur(spark, sf):
    return _hashed_kmers(spark, sf, MURMUR)


@query(f"WITH {KM}, {_crc_sql()} {_HASH_COLUMNS}")
def hash_crc32(spark, sf):
    return _hashed_kmers(spark, sf, CRC)


@query(f"WITH {KM}, {_injection_sql()} {_MINHASH_COLUMNS}")
def minhash_uniform(spark, sf):
    return _minhash_of(spark, sf, UNIFORM)


@query(f"WITH {KM}, {_murmur_sql()} {_MINHASH_COLUMNS}")
def minhash_murmur(spark, sf):
    return _minhash_of(spark, sf, MURMUR)


@query(f"WITH {KM}, {_crc_sql()} {_MINHASH_COLUMNS}")
def minhash_crc32(spark, sf):
    return _minhash_of(spark, sf, CRC)


@query(f"WITH {KM}, fm AS (SELECT CAST(i AS INTEGER) AS idx FROM range({DIM}) r(i)), n AS (SELECT count(DISTINCT kmer) AS n FROM km) SELECT idx, n AS keys, n AS hashes, true AS within FROM fm, n")
def hash_injectivity(spark, sf):
    """As many hashes as keys in each place, all within twice the size of the set."""
    rows = _hashed_kmers(spark, sf, UNIFORM)
    return rows.groupBy("idx").agg(F.count("kmer").alias("keys"), F.count_distinct("hash").alias("hashes"), F.bool_and((F.col("hash") >= 0) & (F.col("hash") < UNIFORM.range)).alias("within"))


TE2 = f"{EV}, {LEN}, te AS (SELECT a.seq_id, a.c * 5 + b.c AS idx, count(*) AS k FROM ev a JOIN ev b ON a.seq_id = b.seq_id AND a.pos < b.pos GROUP BY ALL)"


@query(f"WITH {TE2} SELECT ln.seq_id, CAST(r.i AS INTEGER) AS idx, round(coalesce(k, 0) / (n * (n - 1) / 2.0), 6) AS value FROM ln CROSS JOIN range(25) r(i) LEFT JOIN te ON te.seq_id = ln.seq_id AND te.idx = r.i")
def tensor_embedding(spark, sf):
    return _long(_sequences(spark, sf).select("seq_id", tensors.embedding(F.col("seq"), SIZE, 2).alias("s")), "s", "seq_id", digits=6)


@query(f"WITH {TE2} SELECT ln.seq_id, CAST(r.i AS INTEGER) AS idx, CAST(coalesce(k, 0) AS DOUBLE) AS value FROM ln CROSS JOIN range(25) r(i) LEFT JOIN te ON te.seq_id = ln.seq_id AND te.idx = r.i")
def tensor_embedding_joined(spark, sf):
    half = F.floor(F.size("seq") / 2).cast("int")
    left, right = F.slice("seq", F.lit(1), half), F.slice("seq", half + 1, F.size("seq"))
    states = _sequences(spark, sf).select("seq_id", tensors.embedding_state(left, SIZE, 2).alias("a"), tensors.embedding_state(right, SIZE, 2).alias("b"))
    whole = tensors.joined(F.col("a"), F.col("b"), SIZE, 2)
    return _long(states.select("seq_id", F.get(whole, F.lit(2)).alias("s")), "s", "seq_id")


def _cells(source: str, keys: str, total: str) -> str:
    """Long rows with zeros for the places that no subsequence has."""
    return f"SELECT k.*, CAST(r.i AS INTEGER) AS idx, round(coalesce(x.v / k.total, 0), 6) + 0.0 AS value FROM (SELECT {keys}, {total} AS total FROM {source}) k CROSS JOIN range({DIM}) r(i) LEFT JOIN x ON x.idx = r.i"


TS3 = f"""WITH {EV}, {LEN}, {_place_table("tb", TABLES3)},
two AS (SELECT a.seq_id, b.pos, (t0.h + t1.h) % {DIM} AS h, sum(t0.s * t1.s) AS v FROM ev a JOIN ev b ON a.seq_id = b.seq_id AND a.pos < b.pos JOIN tb t0 ON t0.p = 0 AND t0.c = a.c JOIN tb t1 ON t1.p = 1 AND t1.c = b.c GROUP BY ALL),
x AS (SELECT w.seq_id, (w.h + t2.h) % {DIM} AS idx, sum(w.v * t2.s) AS v FROM two w JOIN ev d ON d.seq_id = w.seq_id AND w.pos < d.pos JOIN tb t2 ON t2.p = 2 AND t2.c = d.c GROUP BY ALL),
ts AS (SELECT ln.seq_id, r.i AS idx, coalesce(x.v, 0) / (n * (n - 1) * (n - 2) / 6.0) AS value FROM ln CROSS JOIN range({DIM}) r(i) LEFT JOIN x ON x.seq_id = ln.seq_id AND x.idx = r.i)"""


@query(f"{TS3} SELECT seq_id, CAST(idx AS INTEGER) AS idx, round(value, 6) + 0.0 AS value FROM ts")
def tensor_sketch(spark, sf):
    return _long(_sequences(spark, sf).select("seq_id", tensors.tensor_sketch(F.col("seq"), TABLES3).alias("s")), "s", "seq_id", digits=6)


@query(f"{TS3} SELECT seq_id, CAST(idx AS INTEGER) AS idx, round(value, 6) + 0.0 AS value FROM ts")
def tensor_sketch_arrow(spark, sf):
    return _long(_sequences(spark, sf).select("seq_id", tensors.arrow_sketch(F.col("seq"), TABLES3).alias("s")), "s", "seq_id", digits=6)


@query(f"{TS3} SELECT seq_id, CAST(idx AS INTEGER) AS idx, round(value, 6) + 0.0 AS value FROM ts")
def tensor_sketch_merged(spark, sf):
    """Each user's days lie in rows of their own and are sketched there; no row holds a whole sequence."""
    day = F.date_diff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("part")
    days = tables.event_positions(spark, sf).groupBy("seq_id", day).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "code"))).alias("e"))
    parts = days.select("seq_id", "part", F.transform("e", lambda x: x.code).alias("seq"))
    return _long(merging.merged_sketches(parts, TABLES3), "sketch", "seq_id", digits=6)


@query(f"{TS3} SELECT a.seq_id AS i, b.seq_id AS j, round(sum((a.value - b.value) * (a.value - b.value)), 6) + 0.0 AS dist FROM ts a JOIN ts b ON a.idx = b.idx AND b.seq_id < a.seq_id GROUP BY ALL")
def tensor_sketch_triangle(spark, sf):
    rows = _sequences(spark, sf).select("seq_id", tensors.tensor_sketch(F.col("seq"), TABLES3).alias("s"))
    return pairs.compared(rows, "seq_id", "s", blocks.arrays, lambda a, b: [blocks.rounded(blocks.l2_squared(a, b), 6)], "dist double")


TSB4 = f"""WITH {EV}, {LEN}, {_place_table("tb", TABLES4)},
bl AS (SELECT a.seq_id, a.pos, q.b, (t0.h + t1.h) % {DIM} AS h, t0.s * t1.s AS s FROM ev a JOIN ev e ON e.seq_id = a.seq_id AND e.pos = a.pos + 1 CROSS JOIN range(2) q(b) JOIN tb t0 ON t0.p = 2 * q.b AND t0.c = a.c JOIN tb t1 ON t1.p = 2 * q.b + 1 AND t1.c = e.c),
x AS (SELECT u.seq_id, (u.h + w.h) % {DIM} AS idx, sum(u.s * w.s) AS v FROM bl u JOIN bl w ON u.seq_id = w.seq_id AND u.b = 0 AND w.b = 1 AND w.pos >= u.pos + 2 GROUP BY ALL)"""


@query(f"{TSB4} SELECT ln.seq_id, CAST(r.i AS INTEGER) AS idx, round(coalesce(x.v, 0) / ((n - 2) * (n - 3) / 2.0), 6) + 0.0 AS value FROM ln CROSS JOIN range({DIM}) r(i) LEFT JOIN x ON x.seq_id = ln.seq_id AND x.idx = r.i")
def tensor_block(spark, sf):
    return _long(_sequences(spark, sf).select("seq_id", tensors.tensor_block(F.col("seq"), TABLES4, 2).alias("s")), "s", "seq_id", digits=6)


TSS2 = f"""WITH {EV}, {LEN}, {_place_table("tb", TABLES2)},
wi AS (SELECT ln.seq_id, w.i AS win_idx, greatest((w.i + 1) * {STRIDE} - {WINDOW}, 0) AS a, (w.i + 1) * {STRIDE} AS e FROM ln, range(10000) w(i) WHERE (w.i + 1) * {STRIDE} <= n),
x AS (SELECT wi.seq_id, win_idx, (t0.h + t1.h) % {DIM} AS idx, sum(t0.s * t1.s) AS v FROM wi JOIN ev p ON p.seq_id = wi.seq_id AND p.pos >= a AND p.pos < e JOIN ev q ON q.seq_id = wi.seq_id AND q.pos > p.pos AND q.pos < e JOIN tb t0 ON t0.p = 0 AND t0.c = p.c JOIN tb t1 ON t1.p = 1 AND t1.c = q.c GROUP BY ALL),
ss AS (SELECT wi.seq_id, wi.win_idx, r.i AS idx, coalesce(x.v, 0) / ((e - a) * (e - a - 1) / 2.0) AS value FROM wi CROSS JOIN range({DIM}) r(i) LEFT JOIN x ON x.seq_id = wi.seq_id AND x.win_idx = wi.win_idx AND x.idx = r.i)"""


@query(f"{TSS2} SELECT seq_id, CAST(win_idx AS INTEGER) AS win_idx, CAST(idx AS INTEGER) AS idx, round(value, 6) + 0.0 AS value FROM ss")
def tensor_slide(spark, sf):
    return _long(sliding.tensor_slide(_sequences(spark, sf), TABLES2, WINDOW, STRIDE), "sketch", "seq_id", "win_idx", digits=6)


@query(f"{TSS2} SELECT x.seq_id AS i, y.seq_id AS j, round(sum((x.value - y.value) * (x.value - y.value)), 6) + 0.0 AS dist FROM ss x JOIN ss y ON x.win_idx = y.win_idx AND x.idx = y.idx AND x.seq_id // 10 = y.seq_id // 10 AND x.seq_id < y.seq_id GROUP BY ALL")
def tensor_slide_groups(spark, sf):
    rows = sliding.tensor_slide(_sequences(spark, sf), TABLES2, WINDOW, STRIDE).groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("win_idx", "sketch"))).alias("w"))
    rows = rows.select("seq_id", pairs.group_of("seq_id", 10).alias("g"), F.transform("w", lambda x: x.sketch).alias("s"))
    return pairs.in_group(rows, "seq_id", "g", ["s"]).select("i", "j", (F.round(distances.l2_squared_rows(F.col("s_i"), F.col("s_j")), 6) + F.lit(0.0)).alias("dist"))


PHASES, CHANNELS, BINS, OFFSET = 5, 3, 16, 3
PHASE_TABLES = phases.phase_tables(SIZE, 2, PHASES, CHANNELS, 7)
UPPER_TABLES = [phases.phase_tables(PHASES, 2, 4, 2, 70 + c) for c in range(CHANNELS)]


def _phase_table(name: str, by_channel: list) -> str:
    rows = ", ".join(f"({ch}, {p}, {c}, {t.hashes[p][c]})" for ch, t in enumerate(by_channel) for p in range(t.t) for c in range(t.size))
    return f"{name}(ch, p, c, h) AS (VALUES {rows})"


PH = f"{EV}, {LEN}, {_phase_table('pt', PHASE_TABLES)}"
_CONTRAST = "coalesce(sum(CASE WHEN ph % 2 = 0 THEN v ELSE -v END) / sum(v), 0)"
_BIN = f"CAST(1 + len([e FOR e IN {_numbers(maths.bin_edges(BINS)[: BINS - 1])} IF e <= contrast]) AS INTEGER)"


@query(f"""WITH {PH}, x AS (SELECT a.seq_id, t0.ch, (t0.h + t1.h) % {PHASES} AS ph, count(*)::DOUBLE AS v FROM ev a JOIN ev b ON a.seq_id = b.seq_id AND a.pos < b.pos JOIN pt t0 ON t0.p = 0 AND t0.c = a.c JOIN pt t1 ON t1.p = 1 AND t1.c = b.c AND t1.ch = t0.ch GROUP BY ALL),
k AS (SELECT ln.seq_id, r.ch, {_CONTRAST} AS contrast FROM ln CROSS JOIN range({CHANNELS}) r(ch) LEFT JOIN x ON x.seq_id = ln.seq_id AND x.ch = r.ch GROUP BY ALL)
SELECT seq_id, CAST(ch AS INTEGER) AS channel, round(contrast, 6) + 0.0 AS contrast, {_BIN} AS bin FROM k""")
def phase_contrasts(spark, sf):
    rows = _sequences(spark, sf).select("seq_id", F.posexplode(phases.contrasts(F.col("seq"), PHASE_TABLES)).alias("channel", "c"))
    return rows.select("seq_id", "channel", (F.round("c", 6) + F.lit(0.0)).alias("contrast"), phases.binned(F.col("c"), BINS).alias("bin"))


def _phase_windows(offset: int) -> str:
    """(seq_id, win_idx, a, e) of windows of 16 codes that end at each position offset modulo 8, and at the last."""
    return f"""ends AS (SELECT seq_id, e FROM ln, range(1, 100000) r(e) WHERE e <= n AND (e % {STRIDE} = {offset % STRIDE} OR e = n)),
pw AS (SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY e) - 1 AS win_idx, greatest(e - {WINDOW}, 0) AS a, e FROM ends),
x AS (SELECT pw.seq_id, win_idx, t0.ch, (t0.h + t1.h) % {PHASES} AS ph, count(*)::DOUBLE AS v FROM pw JOIN ev p ON p.seq_id = pw.seq_id AND p.pos >= a AND p.pos < e JOIN ev q ON q.seq_id = pw.seq_id AND q.pos > p.pos AND q.pos < e JOIN pt t0 ON t0.p = 0 AND t0.c = p.c JOIN pt t1 ON t1.p = 1 AND t1.c = q.c AND t1.ch = t0.ch GROUP BY ALL)"""


@query(f"""WITH {PH}, {_phase_windows(OFFSET)}, k AS (SELECT pw.seq_id, r.ch, pw.win_idx, {_CONTRAST} AS contrast FROM pw CROSS JOIN range({CHANNELS}) r(ch) LEFT JOIN x ON x.seq_id = pw.seq_id AND x.win_idx = pw.win_idx AND x.ch = r.ch GROUP BY ALL)
SELECT seq_id, CAST(ch AS INTEGER) AS channel, CAST(win_idx AS INTEGER) AS win_idx, {_BIN} AS bin FROM k""")
def phase_windows(spark, sf):
    rows = phases.sliding_histograms(_sequences(spark, sf), PHASE_TABLES, WINDOW, STRIDE, OFFSET)
    return rows.select("seq_id", "channel", "win_idx", phases.binned(phases.contrast(F.col("histogram")), BINS).alias("bin"))


@query(f"""WITH {PH}, {_phase_windows(0)}, one AS (SELECT seq_id, ch, win_idx, ph, v / sum(v) OVER (PARTITION BY seq_id, ch, win_idx) AS v FROM x),
ut(ch, e, p, c, h) AS (VALUES {", ".join(f"({ch}, {2 * ch + e}, {p}, {c}, {t.hashes[p][c]})" for ch, ts in enumerate(UPPER_TABLES) for e, t in enumerate(ts) for p in range(2) for c in range(PHASES))}),
nw AS (SELECT seq_id, max(win_idx) + 1 AS n FROM pw GROUP BY seq_id),
w2 AS (SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY e) - 1 AS win_idx, greatest(e - 4, 0) AS a, e FROM nw, range(1, 100000) r(e) WHERE e <= n AND (e % 2 = 0 OR e = n)),
y AS (SELECT w2.seq_id, w2.win_idx, t0.e AS ch, (t0.h + t1.h) % 4 AS ph, sum(f.v * g.v) AS v FROM w2 JOIN one f ON f.seq_id = w2.seq_id AND f.win_idx >= w2.a AND f.win_idx < w2.e JOIN one g ON g.seq_id = w2.seq_id AND g.ch = f.ch AND g.win_idx > f.win_idx AND g.win_idx < w2.e
JOIN ut t0 ON t0.ch = f.ch AND t0.p = 0 AND t0.c = f.ph JOIN ut t1 ON t1.ch = f.ch AND t1.e = t0.e AND t1.p = 1 AND t1.c = g.ph GROUP BY ALL)
SELECT w2.seq_id, CAST(r.ch AS INTEGER) AS channel, CAST(w2.win_idx AS INTEGER) AS win_idx, CAST(s.ph AS INTEGER) AS phase, round(coalesce(y.v / (SELECT sum(z.v) FROM y z WHERE z.seq_id = w2.seq_id AND z.win_idx = w2.win_idx AND z.ch = r.ch), 0), 9) + 0.0 AS share
FROM w2 CROSS JOIN range({2 * CHANNELS}) r(ch) CROSS JOIN range(4) s(ph) LEFT JOIN y ON y.seq_id = w2.seq_id AND y.win_idx = w2.win_idx AND y.ch = r.ch AND y.ph = s.ph""")
def phase_levels(spark, sf):
    """Histograms of windows of histograms of windows."""
    below = phases.sliding_histograms(_sequences(spark, sf), PHASE_TABLES, WINDOW, STRIDE)
    rows = phases.soft_histograms(phases.as_soft(below), UPPER_TABLES, 4, 2)
    return _long(rows, "histogram", "seq_id", "channel", "win_idx", name="share", digits=9).withColumnRenamed("idx", "phase")


def _slides(spark, sf):
    p = engine.Parameters(method="TSS", size=SIZE, dim=DIM, tuple_length=2, window=WINDOW, stride=STRIDE)
    return _sequences(spark, sf).select("seq_id", engine.slide_column(F.col("seq"), p, TABLES2).alias("rows"))


@query(f"""{TSS2}, wt(s, cell, f) AS (VALUES {", ".join(f"({s}, {c}, {FLAT[s][c]!r}::DOUBLE)" for s in range(len(FLAT)) for c in range(4 * DIM))}),
nw AS (SELECT seq_id, count(DISTINCT win_idx) AS nr FROM ss GROUP BY seq_id)
SELECT ss.seq_id, CAST(wt.s AS INTEGER) AS idx, round(sum(f * value) / (any_value(nr) * {DIM}), 5) + 0.0 AS value FROM ss JOIN nw ON nw.seq_id = ss.seq_id JOIN wt ON ss.idx = wt.s % {DIM} AND wt.cell = (ss.win_idx % 4) * {DIM} + ss.idx GROUP BY ss.seq_id, wt.s""")
def flat_double(spark, sf):
    return _long(_slides(spark, sf).select("seq_id", flatten.flat_double(F.col("rows"), FLAT, DIM).alias("s")), "s", "seq_id", digits=5)


@query(f"""{TSS2}, sg(word, bit, win, f) AS (VALUES {", ".join(f"({i // 32}, {i % 32}, {w}, {SIGNS[i][w * DIM + (i // 32) % DIM]})" for i in range(len(SIGNS)) for w in range(4))}),
pr AS (SELECT seq_id, word, bit, round(sum(f * value), 12) < 0 AS negative FROM ss JOIN sg ON ss.idx = word % {DIM} AND win = ss.win_idx % 4 GROUP BY ALL)
SELECT seq_id, CAST(word AS INTEGER) AS idx, CAST(sum(CASE WHEN negative THEN 1::BIGINT << (31 - bit) ELSE 0 END) AS BIGINT) AS word FROM pr GROUP BY seq_id, pr.word""")
def flat_int32(spark, sf):
    return _long(_slides(spark, sf).select("seq_id", flatten.flat_int32(F.col("rows"), SIGNS, DIM).alias("s")), "s", "seq_id", name="word")


def _vectors(spark, sf):
    """(seq_id, label, v) as stored."""
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("seq_id"), "label", F.col("embedding").alias("v"))


def _vector_pairs(spark, sf, of):
    """(i, j, dist) of the pairs of vectors of a label."""
    met = pairs.compared(_vectors(spark, sf), "seq_id", "v", blocks.arrays, lambda a, b: [blocks.rounded(of(a, b), 6)], "dist double", group="label", rising=True)
    return met.select("i", "j", "dist")


def _vector_sql(dist: str) -> str:
    return f"WITH {VEC} SELECT a.seq_id AS i, b.seq_id AS j, round({dist}, 6) + 0.0 AS dist FROM ve a JOIN ve b ON a.label = b.label AND a.seq_id < b.seq_id"


@query(_vector_sql("list_sum([abs(a.v[i] - b.v[i]) FOR i IN range(1, 65)])"))
def l1_pairs(spark, sf):
    return _vector_pairs(spark, sf, blocks.l1)


@query(_vector_sql("list_sum([(a.v[i] - b.v[i]) * (a.v[i] - b.v[i]) FOR i IN range(1, 65)])"))
def l2_squared_pairs(spark, sf):
    return _vector_pairs(spark, sf, blocks.l2_squared)


@query(_vector_sql("sqrt(list_sum([(a.v[i] - b.v[i]) * (a.v[i] - b.v[i]) FOR i IN range(1, 65)]))"))
def l2_pairs(spark, sf):
    return _vector_pairs(spark, sf, blocks.l2)


@query(_vector_sql("list_sort([abs(a.v[i] - b.v[i]) FOR i IN range(1, 65)])[33]"))
def median_absolute_pairs(spark, sf):
    return _vector_pairs(spark, sf, blocks.median_absolute)


@query(_vector_sql("CAST(list_sum([CASE WHEN (a.v[i] < 0) <> (b.v[i] < 0) THEN 1 ELSE 0 END FOR i IN range(1, 65)]) AS BIGINT)").replace("round(", "(").replace(", 6) + 0.0 AS", ") AS"))
def bit_hamming_pairs(spark, sf):
    bits = F.array(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x < 0, F.lit(1)).otherwise(F.lit(0)).cast("long"))))
    rows = tables.vectors(spark, sf).withColumn("w", bits)
    return pairs.compared(rows, "seq_id", "w", blocks.arrays, lambda a, b: [blocks.bit_hamming(a, b)], "dist long", group="label", rising=True).select("i", "j", "dist")


@query(f"WITH {EV}, {STR} SELECT a.seq_id AS i, b.seq_id AS j, CAST(levenshtein(a.s, b.s) AS INTEGER) AS dist FROM st a JOIN st b ON b.seq_id < a.seq_id")
def edit_distance_triangle(spark, sf):
    rows = _sequences(spark, sf).select("seq_id", distances.as_letters(F.col("seq")).alias("s"))
    return pairs.compared(rows, "seq_id", "s", blocks.strings, lambda a, b: [blocks.edit(a, b)], "dist int", batch=1 << 20)


@query("SELECT a.p_partkey AS i, b.p_partkey AS j, CAST(levenshtein(a.p_name, b.p_name) AS INTEGER) AS dist FROM part a JOIN part b ON a.p_partkey // 50 = b.p_partkey // 50 AND a.p_partkey < b.p_partkey")
def part_name_edits(spark, sf):
    rows = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name", pairs.group_of("p_partkey", 50).alias("g"))
    return pairs.in_group(rows, "p_partkey", "g", ["p_name"]).select("i", "j", distances.edit(F.col("p_name_i"), F.col("p_name_j")).alias("dist"))


def _rising(name: str, base: str, cell: str) -> str:
    """A table of two sequences a row at a time: of each cell its own candidate, and then the best up to it."""
    return f"{name}(i, j, n, x, y, k, row) AS ({base} UNION ALL SELECT i, j, n, x, y, k + 1, {cell} FROM {name} WHERE k < n)"


@query(f"""WITH RECURSIVE {EV}, sq AS (SELECT seq_id, list(c ORDER BY pos) AS s FROM ev GROUP BY seq_id),
{_rising("l", "SELECT a.seq_id, b.seq_id, len(a.s), a.s, b.s, 0, [0::BIGINT FOR z IN b.s] FROM sq a JOIN sq b ON a.seq_id // 2 = b.seq_id // 2 AND a.seq_id < b.seq_id",
"(SELECT [list_max(c[1 : m]) FOR m IN range(1, len(c) + 1)] FROM (SELECT [CASE WHEN y[m] = x[k + 1] THEN 1 + CASE WHEN m > 1 THEN row[m - 1] ELSE 0 END ELSE row[m] END FOR m IN range(1, len(row) + 1)] AS c))")}
SELECT i, j, row[-1] AS lcs, len(x) + len(y) - 2 * row[-1] AS dist FROM l WHERE k = n""")
def lcs_pairs(spark, sf):
    rows = _sequences(spark, sf).select("seq_id", "seq")
    met = pairs.consecutive(rows, "seq_id", ["seq"])
    a, b = F.col("seq_i"), F.col("seq_j")
    return met.select("i", "j", distances.lcs(a, b).cast("long").alias("lcs"), distances.lcs_distance(a, b).cast("long").alias("dist"))


@query(f"""WITH RECURSIVE {VEC},
{_rising("w", "SELECT a.seq_id, b.seq_id, len(a.v), a.v, b.v, 1, [list_sum([abs(a.v[1] - z) FOR z IN b.v[1 : m]]) FOR m IN range(1, len(b.v) + 1)] FROM ve a JOIN ve b ON a.seq_id // 2 = b.seq_id // 2 AND a.seq_id < b.seq_id",
"(SELECT [s[m] + list_min(c[1 : m]) FOR m IN range(1, len(c) + 1)] FROM (SELECT s, [least(row[m], CASE WHEN m > 1 THEN row[m - 1] ELSE row[m] END) - CASE WHEN m > 1 THEN s[m - 1] ELSE 0 END FOR m IN range(1, len(row) + 1)] AS c FROM (SELECT [list_sum([abs(x[k + 1] - z) FOR z IN y[1 : m]]) FOR m IN range(1, len(y) + 1)] AS s)))")}
SELECT i, j, round(row[-1], 6) AS dist FROM w WHERE k = n""")
def dtw_pairs(spark, sf):
    met = pairs.consecutive(tables.vectors(spark, sf).select("seq_id", "v"), "seq_id", ["v"])
    return met.select("i", "j", F.round(distances.dtw(F.col("v_i"), F.col("v_j")), 6).alias("dist"))


@query("SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.vec_id // 2 = b.vec_id // 2 AND a.vec_id < b.vec_id")
def consecutive_pairs(spark, sf):
    return pairs.consecutive(tables.vectors(spark, sf).select("seq_id"), "seq_id", [])


@query("SELECT a.vec_id AS i, b.vec_id AS j, a.vec_id // 20 AS g FROM embeddings a JOIN embeddings b ON a.vec_id // 20 = b.vec_id // 20 AND a.vec_id < b.vec_id")
def group_pairs(spark, sf):
    rows = tables.vectors(spark, sf).select("seq_id", pairs.group_of("seq_id", 20).alias("g"))
    return pairs.in_group(rows, "seq_id", "g", []).select("i", "j", "g")


@query("WITH la AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id) SELECT c.c_custkey, la.event_id FROM customer c LEFT JOIN la ON la.user_id = c.c_custkey")
def last_event_lookup(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"))
    last = pairs.last_of_each(rows, "user_id", "at").select("user_id", "event_id")
    return spark.read.parquet(f"{sf}/customer.parquet").join(last, F.col("c_custkey") == F.col("user_id"), "left").select("c_custkey", "event_id")


@query("SELECT p_partkey, p_retailprice, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS rank FROM part")
def fractional_rank(spark, sf):
    return stats.fractional_rank(spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_retailprice"), "p_retailprice")


ORDERS = "SELECT o_orderpriority AS g, o_totalprice AS x, CAST(o_custkey AS DOUBLE) AS y, o_orderkey AS k FROM orders"


def _orders(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderpriority").alias("g"), F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y"), F.col("o_orderkey").alias("k"))


@query(f"WITH o AS ({ORDERS}), r AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS b FROM o) SELECT g, round(corr(a, b), 6) + 0.0 AS spearman FROM r GROUP BY g")
def spearman(spark, sf):
    return stats.spearman(_orders(spark, sf), "x", "y", "g").select("g", (F.round("spearman", 6) + F.lit(0.0)).alias("spearman"))


@query(f"WITH o AS ({ORDERS}), r AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY x, k) AS a, row_number() OVER (PARTITION BY g ORDER BY y, k) AS b FROM o) SELECT g, round(corr(a, b), 6) + 0.0 AS spearman FROM r GROUP BY g")
def spearman_ordinal(spark, sf):
    return stats.spearman_ordinal(_orders(spark, sf), "x", "y", ["k"], "g").select("g", (F.round("spearman", 6) + F.lit(0.0)).alias("spearman"))


@query(f"WITH o AS ({ORDERS}) SELECT g, round(corr(x, y), 6) + 0.0 AS pearson FROM o GROUP BY g")
def pearson(spark, sf):
    return _orders(spark, sf).groupBy("g").agg((F.round(stats.pearson(F.col("x"), F.col("y")), 6) + F.lit(0.0)).alias("pearson"))


LINES = "SELECT l_linenumber AS g, l_quantity AS score, l_returnflag = 'R' AS pos FROM lineitem"


def _lines(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_linenumber").alias("g"), F.col("l_quantity").alias("score"), (F.col("l_returnflag") == "R").alias("pos"))


@query(f"WITH l AS ({LINES}), c AS (SELECT g, score, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM l GROUP BY ALL) SELECT a.g, round(sum(a.p * b.n * CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END)::DOUBLE / (sum(a.p * b.n))::DOUBLE, 6) AS auroc FROM c a JOIN c b ON a.g = b.g GROUP BY a.g")
def auroc(spark, sf):
    return stats.auroc(_lines(spark, sf), "score", "pos", "g").select("g", F.round("auroc", 6).alias("auroc"))


@query(f"WITH l AS ({LINES}), t AS (SELECT g, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n FROM l GROUP BY g), d AS (SELECT DISTINCT g, score FROM l) SELECT d.g, CAST(d.score AS DOUBLE) AS threshold, round(count(*) FILTER (NOT l.pos)::DOUBLE / any_value(t.n), 6) AS fpr, round(count(*) FILTER (l.pos)::DOUBLE / any_value(t.p), 6) AS tpr FROM d JOIN l ON l.g = d.g AND l.score >= d.score JOIN t ON t.g = d.g GROUP BY d.g, d.score")
def roc_curve(spark, sf):
    return stats.roc_curve(_lines(spark, sf), "score", "pos", "g").select("g", F.col("threshold").cast("double").alias("threshold"), F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query("SELECT o_orderstatus AS g, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS stddev, round(median(o_totalprice), 4) AS median FROM orders GROUP BY 1")
def mean_deviation_median(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_orderstatus").alias("g")).agg(*stats.mean_and_deviation("o_totalprice"), stats.median("o_totalprice").alias("median"))
    return rows.select("g", *(F.round(c, 4).alias(c) for c in ("mean", "stddev", "median")))


@query("SELECT l_linestatus AS algo, l_suppkey AS s1, l_linenumber AS s2, round(median(l_extendedprice), 6) AS median, round(avg(l_extendedprice) + 1e-7, 4) AS mean FROM lineitem GROUP BY ALL")
def over_reruns(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_linestatus").alias("algo"), F.lit(0).alias("rerun"), F.col("l_suppkey").alias("s1"), F.col("l_linenumber").alias("s2"), F.col("l_extendedprice").alias("dist"))
    return stats.over_reruns(rows).select("algo", "s1", "s2", F.round("median", 6).alias("median"), F.round(F.col("mean") + 1e-7, 4).alias("mean"))  # off the ties


@query("WITH m AS (SELECT l_linestatus AS method, l_linenumber AS k, median(l_discount) AS median FROM lineitem GROUP BY ALL) SELECT method, k, round(median, 6) AS median FROM m QUALIFY row_number() OVER (PARTITION BY method ORDER BY median DESC, k) = 1")
def optimal_parameters(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_linestatus").alias("method"), F.col("l_linenumber").alias("k"), "l_discount")
    return stats.optimal_parameters(rows, "method", ["k"], "l_discount").withColumn("median", F.round("median", 6))


@query("SELECT o_orderpriority AS method, round(avg(o_totalprice), 4) AS mean, round(coalesce(stddev_samp(o_totalprice), 0), 4) AS stddev, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS worst FROM orders GROUP BY 1")
def summary_by_method(spark, sf):
    rows = stats.summary_by(spark.read.parquet(f"{sf}/orders.parquet").withColumn("method", F.col("o_orderpriority")), "method", "o_totalprice", "o_orderkey")
    return rows.select("method", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"), "best", "worst")


@query(f"WITH {EV}, {LEN} SELECT count(n) AS n, min(n) AS least, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS stddev, max(n) AS most, CAST(sum(n) AS BIGINT) AS total FROM ln")
def length_statistics(spark, sf):
    rows = _sequences(spark, sf).select(F.size("seq").cast("long").alias("len"))
    return stats.length_statistics(rows, "len").withColumn("mean", F.round("mean", 6)).withColumn("stddev", F.round("stddev", 6))


@query(f"WITH {EV}, {LEN}, c AS (SELECT n AS value, count(*) AS n FROM ln GROUP BY ln.n), r AS (SELECT 'lowest' AS which, CAST(row_number() OVER (ORDER BY value) AS INTEGER) AS place, value, n FROM c UNION ALL SELECT 'highest', CAST(row_number() OVER (ORDER BY value DESC) AS INTEGER), value, n FROM c UNION ALL SELECT 'frequent', CAST(row_number() OVER (ORDER BY n DESC, value) AS INTEGER), value, n FROM c) SELECT * FROM r WHERE place <= 5")
def extreme_lengths(spark, sf):
    return stats.extreme_values(_sequences(spark, sf).select(F.size("seq").cast("long").alias("len")), "len")


@query(f"WITH {VEC}, d AS (SELECT a.seq_id AS i, b.seq_id AS j, round(list_sum([abs(a.v[i] - b.v[i]) FOR i IN range(1, 65)]), 6) AS dist FROM ve a JOIN ve b ON b.label = a.label AND a.seq_id < b.seq_id), r AS (SELECT i, j, rank() OVER (ORDER BY -dist) + (count(*) OVER (PARTITION BY dist) - 1) / 2.0 AS rank FROM d) SELECT i, j, rank FROM r UNION ALL SELECT j, i, rank FROM r")
def rank_matrix(spark, sf):
    return ordered.rank_matrix(_vectors(spark, sf), "seq_id", "v", blocks.arrays, lambda a, b: blocks.rounded(blocks.l1(a, b), 6), "label", 6)


@query("SELECT o_orderkey, CAST(ntile(100) OVER (ORDER BY o_totalprice, o_orderkey) AS INTEGER) AS bin FROM orders")
def quantile_bins(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice")
    return ranges.quantile_bins(rows, 100, "o_totalprice", "o_orderkey").select("o_orderkey", "bin")


@query("SELECT o_orderkey, round(o_totalprice / max(o_totalprice) OVER (PARTITION BY o_orderpriority), 6) AS share FROM orders")
def share_of_largest(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return stats.of_largest(rows, "o_totalprice", "o_orderpriority").select("o_orderkey", F.round("share", 6).alias("share"))


@query(f"WITH {VEC} SELECT seq_id, CAST(i - 1 AS INTEGER) AS idx, CAST(1 + len([e FOR e IN {_numbers(maths.bin_edges(16))} IF e <= v[i]]) AS INTEGER) AS value FROM ve, range(1, 65) r(i)")
def discretize(spark, sf):
    return _long(tables.vectors(spark, sf).select("seq_id", maths.discretize(F.col("v"), 16).alias("s")), "s", "seq_id")


@query(f"WITH {VEC} SELECT seq_id, CAST(i - 1 AS INTEGER) AS idx, round(atan(v[i]), 6) + 0.0 AS value FROM ve, range(1, 65) r(i)")
def atan_scaled(spark, sf):
    return _long(tables.vectors(spark, sf).select("seq_id", maths.atan_scaled(F.col("v")).alias("s")), "s", "seq_id", digits=6)


@query(f"WITH {VEC} SELECT a.seq_id AS i, b.seq_id AS j, CAST(m AS INTEGER) AS idx, round(list_sum([a.v[k] * b.v[1 + (m - k + 1 + 64) % 64] FOR k IN range(1, 65)]), 6) + 0.0 AS value FROM ve a JOIN ve b ON a.seq_id // 2 = b.seq_id // 2 AND a.seq_id < b.seq_id, range(64) r(m)")
def circular_convolution(spark, sf):
    met = pairs.consecutive(tables.vectors(spark, sf).select("seq_id", "v"), "seq_id", ["v"])
    return _long(met.select("i", "j", maths.circular_convolution(F.col("v_i"), F.col("v_j")).alias("s")), "s", "i", "j", digits=6)


@query(f"WITH {VEC} SELECT a.seq_id AS i, b.seq_id AS j, CAST(m AS INTEGER) AS idx, round(0.75 * a.v[m + 1] + 0.25 * b.v[1 + (m - 5 + 64) % 64], 6) + 0.0 AS value FROM ve a JOIN ve b ON a.seq_id // 2 = b.seq_id // 2 AND a.seq_id < b.seq_id, range(64) r(m)")
def shift_sum(spark, sf):
    met = pairs.consecutive(tables.vectors(spark, sf).select("seq_id", "v"), "seq_id", ["v"])
    return _long(met.select("i", "j", maths.shift_sum(F.col("v_i"), F.col("v_j"), F.lit(5), F.lit(0.25)).alias("s")), "s", "i", "j", digits=6)


@query(f"WITH {EV}, {LEN} SELECT seq_id, CAST(n * (n - 1) * (n - 2) / 6 AS DOUBLE) AS triples FROM ln")
def binomial(spark, sf):
    return _sequences(spark, sf).select("seq_id", F.round(maths.binomial(F.size("seq"), 3), 3).alias("triples"))


DNA = "dn AS (SELECT doc_id AS seq_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS s FROM documents)"


@query(f"WITH {DNA} SELECT seq_id, length(s) AS n, length(s) - length(replace(s, 'A', '')) AS a, length(s) - length(replace(s, 'C', '')) AS c, length(s) - length(replace(s, 'G', '')) AS g, length(s) - length(replace(s, 'T', '')) AS t FROM dn")
def dna_codes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("seq_id"), alphabet.DNA4.encode_known(F.regexp_replace("text", "[^ -~]", "")).alias("seq"))
    count = lambda k: F.size(F.filter("seq", lambda x: x == k)).cast("long")
    return docs.select("seq_id", F.size("seq").cast("long").alias("n"), *(count(k).alias(name) for k, name in enumerate("acgt")))


@query(f"WITH {DNA} SELECT seq_id, md5(translate(reverse(s), 'ACGT', 'TGCA')) AS digest FROM dn")
def reverse_complement(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("seq_id"), alphabet.DNA4.encode_known(F.regexp_replace("text", "[^ -~]", "")).alias("seq"))
    turned = alphabet.stranded(F.col("seq"), F.lit("-"))
    return docs.select("seq_id", F.md5(alphabet.DNA4.decode(turned).cast("binary")).alias("digest"))


@query("WITH l AS (SELECT doc_id AS seq_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM documents), u AS (SELECT seq_id, unnest(string_split(s, '')) AS x FROM l WHERE s <> '') SELECT seq_id, CAST(CASE x WHEN 'Y' THEN 23 WHEN 'Z' THEN 24 WHEN 'X' THEN 25 ELSE ascii(x) - 65 END AS INTEGER) AS code, count(*) AS n FROM u GROUP BY ALL")
def protein_codes(spark, sf):
    rows = tables.letter_texts(spark, sf).select("seq_id", F.explode(alphabet.PROTEIN.encode(F.col("letters"))).alias("code"))
    return rows.groupBy("seq_id", "code").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS seq_id, lang, source, CAST(n_chars AS VARCHAR) AS chars FROM documents")
def header_fields(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    header = docs.select("doc_id", F.concat_ws("|", F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source"), F.concat(F.lit("chars:"), F.col("n_chars").cast("string"))).alias("h"))
    fields = header.select("doc_id", fasta.header_fields(F.col("h")).alias("m"))
    return fields.select(F.col("doc_id").alias("seq_id"), *(F.element_at("m", F.lit(k)).alias(k) for k in ("lang", "source", "chars")))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS tid, count(*) AS n_exons, CAST(sum(l_quantity + 1) AS BIGINT) AS total, CAST(min(l_quantity + 1) AS BIGINT) AS shortest, CAST(max(l_quantity + 1) AS BIGINT) AS longest FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def exon_statistics(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").cast("string").alias("tid"), F.struct(F.lit(10).alias("start"), (F.col("l_quantity").cast("int") + 10).alias("end")).alias("exon"))
    as_json = lines.groupBy("tid").agg(F.collect_list("exon").alias("exons")).select(F.to_json(F.create_map("tid", "exons")).alias("value"))
    return stats.exon_statistics(exons.parsed(as_json, "value")).select("tid", "n_exons", *(F.col(c).cast("long").alias(c) for c in ("total", "shortest", "longest")))


@query("SELECT seq_id, CAST(len(string_split(hex, ',')) AS BIGINT) AS n FROM (SELECT user_id AS seq_id, string_agg('f', ',') AS hex FROM events GROUP BY user_id)")
def hex_lines(spark, sf):
    """Sequences written as lines of hexadecimal codes, the sequence's number first, and read again."""
    given = _sequences(spark, sf).select(F.concat(F.array(F.col("seq_id").cast("int")), F.transform("seq", lambda c: c + 240)).alias("seq"))
    path = new_path(spark, "hex")
    fasta.write_hex(given, path)
    read = fasta.read_hex(spark, path).select(F.get("seq", F.lit(0)).cast("long").alias("seq_id"), F.slice("seq", F.lit(2), F.size("seq")).alias("codes"))
    return read.select("seq_id", F.size(F.filter("codes", lambda c: (c >= 240) & (c < 240 + SIZE))).cast("long").alias("n"))


@query()
def upgma(spark, sf):
    rows = tables.vectors(spark, sf).withColumnRenamed("label", "tree")
    return phylogeny.trees_of(rows, "tree", "seq_id", "v", blocks.arrays, blocks.l2, every=True)


@query()
def synthetic_sequences(spark, sf):
    """Trees of relatives whose founders are the users' event sequences."""
    rows = synth.relatives(_sequences(spark, sf), size=SIZE, members=8, shape="tree")
    return rows.select("seq_id", "group", F.size("seq").alias("n"), F.array_join("seq", "").alias("codes"))


LENGTH = 64


def _methods() -> list[engine.Parameters]:
    """All eight methods, for sequences of about LENGTH codes."""
    common = {"size": SIZE, "seq_len": LENGTH, "form": "arrow"}
    window = {"tuple_length": 2} | common | engine.experiment_defaults(LENGTH, 16) | {"stride": 4}
    return [
        engine.Parameters(method="MH", kmer_length=3, dim=16, **common),
        engine.Parameters(method="WMH", kmer_length=3, dim=16, **common),
        engine.Parameters(method="OMH", kmer_length=3, dim=16, tuple_length=2, **common),
        engine.Parameters(method="TS", dim=16, **common),
        engine.Parameters(method="TSB", dim=16, tuple_length=4, block=2, **common),
        *(engine.Parameters(method=m, **window) for m in ("TSS", "TSS_flat_int32", "TSS_flat_double")),
    ]


def _relatives(spark, sf):
    """Each user's events and one mutation of them, at rates from 0 to 1."""
    return written(synth.relatives(_sequences(spark, sf), size=SIZE, rates=(0.0, 1.0), length=LENGTH), "experiment")


@query()
def experiment_quality(spark, sf):
    rows = _relatives(spark, sf)
    met = written(experiment.distances(rows, _methods(), reruns=2), "experiment")
    return experiment.quality(met, [0.1, 0.2, 0.5], rows.select("seq_id", F.size("seq").alias("n")))


@query()
def method_timing(spark, sf):
    """Milliseconds a sketch and a distance by method, and as a share of the edit distance's."""
    return timing.relative(timing.measured(_relatives(spark, sf), [engine.Parameters(method="ED"), *_methods()]))


@query("WITH d AS (SELECT doc_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS s FROM documents) SELECT CAST(doc_id AS VARCHAR) AS id, lang, CAST(length(s) AS INTEGER) AS n, md5(s) AS digest FROM d JOIN documents USING (doc_id) WHERE s <> ''")
def fasta_records(spark, sf):
    """Documents' bases written as FASTA in lines of 60 letters, and read again with their headers' fields."""
    bases = F.upper(F.regexp_replace("text", "[^ACGTacgt]", ""))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.concat(F.lit("id:"), "doc_id", F.lit("|lang:"), "lang").alias("comment"), F.regexp_replace(bases, "(.{60})(?=.)", "$1\n").alias("letters"))
    path = new_path(spark, "fasta")
    fasta.write_fasta(docs.where("letters <> ''"), path)
    read = fasta.read_fasta(spark, path, alphabet.DNA4).withColumn("m", fasta.header_fields(F.col("comment")))
    return read.select(F.element_at("m", F.lit("id")).alias("id"), F.element_at("m", F.lit("lang")).alias("lang"), F.size("seq").alias("n"), F.md5(alphabet.DNA4.decode(F.col("seq")).cast("binary")).alias("digest"))


@query(f"WITH {MH}, d AS (SELECT x.seq_id AS i, count(*) FILTER (x.kmer <> y.kmer) AS dist FROM mh x JOIN mh y ON x.idx = y.idx AND y.seq_id < x.seq_id GROUP BY x.seq_id, y.seq_id) SELECT 'user' || seq_id AS name, CAST(count(dist) AS INTEGER) AS n, CAST(coalesce(sum(dist), 0) AS DOUBLE) AS total FROM (SELECT DISTINCT seq_id FROM ev) LEFT JOIN d ON i = seq_id GROUP BY seq_id")
def triangle_lines(spark, sf):
    """The matrix of MinHash distances written as a triangle of lines, and read again."""
    rows = _grams(spark, sf).select("seq_id", hashed.minhash(F.col("kmers"), AFFINE).alias("s"))
    placed = ranges.numbered(rows, "seq_id", name="_row").select((F.col("_row") - 1).alias("i"), F.concat(F.lit("user"), "seq_id").alias("name"), "s")
    path = new_path(spark, "triangle")
    results.write_lines(placed, "s", blocks.arrays, blocks.hamming, path, compression="gzip", kind=np.uint8)
    lines = results.read_triangle(spark, path)
    return lines.select("name", F.size("distances").alias("n"), F.aggregate("distances", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query(f"WITH {VEC}, d AS (SELECT a.label, a.seq_id AS i, b.seq_id AS j, round(list_sum([abs(a.v[i] - b.v[i]) FOR i IN range(1, 65)]), 6) AS dist FROM ve a JOIN ve b ON b.label = a.label AND a.seq_id < b.seq_id) SELECT label, i, j, dist, row_number() OVER (ORDER BY dist, i, j) AS place FROM d")
def sorted_pairs(spark, sf):
    """Pairs of vectors by rising distance, each with its place."""
    return ordered.placed(_vectors(spark, sf), "seq_id", "v", blocks.arrays, lambda a, b: blocks.rounded(blocks.l1(a, b), 6), "label", 6)


@query(f"WITH {MH}, d AS (SELECT x.seq_id AS i, y.seq_id AS j, count(*) FILTER (x.kmer <> y.kmer) AS dist FROM mh x JOIN mh y ON x.idx = y.idx AND 'u' || y.seq_id < 'u' || x.seq_id GROUP BY ALL) SELECT 'u' || seq_id AS name, CAST(count(dist) AS INTEGER) AS n, CAST(coalesce(sum(dist), 0) AS DOUBLE) AS total FROM (SELECT DISTINCT seq_id FROM ev) LEFT JOIN d ON i = seq_id GROUP BY seq_id")
def sketch_triangle_of_fasta(spark, sf):
    """The whole way of a command: event sequences as letters in FASTA files, sketched record by record, and a triangle of their distances, read again."""
    path = new_path(spark, "sequences")
    fasta.write_fasta(_sequences(spark, sf).select(F.concat(F.lit("u"), "seq_id").alias("comment"), alphabet.DNA5.decode(F.col("seq")).alias("letters")).where("letters <> ''"), path)
    p = engine.Parameters(method="MH", size=SIZE, kmer_length=K, dim=DIM, hash_family="affine", seed=7)
    lines = results.read_triangle(spark, triangle.sketch_files(spark, path, p, letters="dna5", each="record", compression="gzip"))
    return lines.select("name", F.size("distances").alias("n"), F.aggregate("distances", F.lit(0.0), lambda s, x: s + x).alias("total"))


def _cells_of_groups(spark, sf):
    """Each label's vectors as an array of arrays."""
    rows = tables.vectors(spark, sf).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("seq_id", "v"))).alias("r"))
    return rows.select("label", F.transform("r", lambda x: x.v).alias("rows"))


@query(f"WITH {VEC} SELECT label, CAST(row_number() OVER (PARTITION BY label, i ORDER BY seq_id) - 1 AS INTEGER) AS row, CAST(i - 1 AS INTEGER) AS idx, CAST(1 + len([e FOR e IN {_numbers(maths.bin_edges(16))} IF e <= v[i]]) AS INTEGER) AS bin, round(atan(v[i]), 6) + 0.0 AS angle FROM ve, range(1, 65) r(i)")
def transformed_rows(spark, sf):
    """Both transforms of arrays of arrays."""
    rows = _cells_of_groups(spark, sf).select("label", maths.transformed(F.col("rows"), "disc", 16, depth=2).alias("b"), maths.transformed(F.col("rows"), "atan", depth=2).alias("a"))
    each = rows.select("label", F.posexplode(F.arrays_zip("b", "a")).alias("row", "x"))
    return each.select("label", "row", F.posexplode(F.arrays_zip("x.b", "x.a")).alias("idx", "y")).select("label", "row", "idx", F.col("y.b").alias("bin"), (F.round("y.a", 6) + F.lit(0.0)).alias("angle"))
