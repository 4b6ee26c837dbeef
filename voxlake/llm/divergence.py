"""Source divergence audit: how the term distributions of each language's sources differ, by systolic rotation.

1. Terms are counted per (lang, source), first in each task and then over all; a language keeps the terms that enough of its
   documents hold.
2. The kept vocabulary is cut into cells of some thousand terms. In each cell every group (a source of the cell's language)
   has a slot and a vector of smoothed shares, packed as the few terms that differ from the share of an absent term. The
   vectors of a cell are made where its terms meet, and the same pass keeps each group's highest terms in a local heap.
3. Groups stay in their partitions, dealt once by (lang, cell, slot). In the rounds of a round-robin tournament the packed
   vectors circulate: in round r slot i meets slot (r - i) mod m, the higher slot's vector going to the lower's partition.
   Each meeting yields one partial sum, which counts in both directions. A round moves half of the vectors at most, so what
   is under way is never more than the vectors themselves; no vector is sent to all its peers at once.

All arithmetic is exact: counts are long, shares come from long division.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable, tasks_for
from .text import LOWER, pieces, release, utf8

PRIOR = 5  # added to each count

# Letters A-Z and a-z and all bytes of other scripts belong to terms.
_IN_TERM = np.array([b >= 128 or 65 <= b < 91 or 97 <= b < 123 for b in range(256)])


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(row, term) of all terms of some rows of text, in order."""
    inside = _IN_TERM[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]  # a term does not run over the end of a row
    start = np.flatnonzero(first)
    compact = LOWER[data[inside]]
    before = np.cumsum(inside) - inside
    cuts = np.append(before[start], len(compact)).astype(np.int32)
    row = np.searchsorted(offsets, start, "right") - 1
    return row, pa.StringArray.from_buffers(len(start), pa.py_buffer(cuts.tobytes()), pa.py_buffer(compact.tobytes()))


def term_counts(docs: DataFrame, piece: int = 4 << 20) -> DataFrame:
    """(lang, source, term, occ, docs) of docs(lang, source, text), counted within each piece of a task; to be summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", piece):
            row, term = _terms(*utf8(batch.column(2)))
            if not len(row):
                continue
            coded = term.dictionary_encode()
            words = len(coded.dictionary)
            code = coded.indices.to_numpy().astype(np.int64)
            held, occ = np.unique(row * words + code, return_counts=True)
            groups = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["lang", "source"])
            names = pc.binary_join_element_wise(pc.cast(pc.binary_length(batch.column(0)), pa.string()), batch.column(0), batch.column(1), ":").dictionary_encode()
            of = names.indices.to_numpy().astype(np.int64)
            lead = np.zeros(len(names.dictionary), np.int64)
            lead[of[::-1]] = np.arange(len(of))[::-1]
            key, back = np.unique(of[held // words] * words + held % words, return_inverse=True)
            group = groups.take(pa.array(lead[key // words]))
            sums = np.bincount(back, occ).astype(np.int64), np.bincount(back)
            for at in range(0, len(key), 1 << 16):
                part = slice(at, at + (1 << 16))
                here = group.slice(at, 1 << 16)
                yield pa.RecordBatch.from_arrays([here.field(0), here.field(1), coded.dictionary.take(pa.array(key[part] % words)), *(pa.array(s[part]) for s in sums)], ["lang", "source", "term", "occ", "docs"])
            release()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, occ long, docs long")


def _shares(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10 ** 9 * (count + PRIOR) / total) of many counts, by long division in three steps of a thousand; total is
    below 9e15."""
    q, r = np.divmod(count + PRIOR, total)
    for _ in range(3):
        step, r = np.divmod(r * 1000, total)
        q = q * 1000 + step
    return q + 1


def _pack(at: np.ndarray, value: np.ndarray) -> bytes:
    """Places, as gaps, and values of a sparse vector."""
    gaps = np.diff(at, prepend=0).astype(np.int32)
    return zlib.compress(gaps.tobytes() + value.astype(np.int32).tobytes(), 1)


def _unpack(packed: bytes, size: int, absent: int) -> np.ndarray:
    both = np.frombuffer(zlib.decompress(packed), np.int32)
    out = np.full(size, absent, np.int64)
    half = len(both) // 2
    out[np.cumsum(both[:half])] = both[half:]
    return out


def _vectors(rows: DataFrame, top: int) -> DataFrame:
    """The cells' vectors and local heaps from rows(lang, cell, term, source, occ, slot, n, n_lang, kept): for each group of a
    cell one row without term, which carries slot, sums and V, before the terms in order."""
    schema = "lang string, source string, cell int, slot int, size int, absent long, vector binary, terms array<string>, values array<long>"

    def cell(t: pa.Table) -> pa.RecordBatch:
        lead = t.filter(pc.is_null(t.column("term")))
        data = t.filter(pc.is_valid(t.column("term")))
        term = data.column("term").combine_chunks()
        coded = term.dictionary_encode()  # in order of the terms, as they come sorted
        coded = coded if isinstance(coded, pa.DictionaryArray) else coded.combine_chunks()
        at, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        occ = data.column("occ").to_numpy()
        names = lead.column("source").to_pylist()
        where = {s: k for k, s in enumerate(names)}
        group = np.array([where[s] for s in data.column("source").to_pylist()], np.int64)
        spelled = coded.dictionary.to_pylist()
        in_lang = np.bincount(at, occ, size).astype(np.int64) if occ.sum() < 1 << 52 else np.array([int(occ[at == k].sum()) for k in range(size)], np.int64)
        kept, n_lang = (int(lead.column(c)[0].as_py()) for c in ("kept", "n_lang"))
        q = _shares(in_lang, n_lang + PRIOR * kept) if size else in_lang
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(len(names) + 1))
        out = []
        for k, n in enumerate(lead.column("n").to_pylist()):
            own = order[cuts[k] : cuts[k + 1]]
            place = np.sort(at[own])
            own = own[np.argsort(at[own], kind="stable")]
            total = n + PRIOR * kept
            absent = int(_shares(np.zeros(1, np.int64), total)[0]) if total else 0
            p = _shares(occ[own], total) if len(own) else np.zeros(0, np.int64)
            value = p - q[place]
            over = np.flatnonzero(value > 0)
            if len(over) > top:  # those at the least value of the best, too, as ties are ordered by term
                over = over[value[over] >= -np.partition(-value[over], top - 1)[top - 1]]
            best = heapq.nsmallest(top, ((-int(value[i]), spelled[place[i]].encode(), int(place[i])) for i in over))
            out.append((absent, _pack(place, p), [spelled[i] for _, _, i in best], [-v for v, _, _ in best]))
        kinds = (pa.int64(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()))
        made = [pa.array(c, kind) for c, kind in zip(zip(*out), kinds)]
        same = [lead.column(c).combine_chunks() for c in ("lang", "source", "cell", "slot")]
        return pa.RecordBatch.from_arrays([*same, pa.array([size] * len(names), pa.int32()), *made], ["lang", "source", "cell", "slot", "size", "absent", "vector", "terms", "values"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def whole(t: pa.Table, last: bool) -> Iterator[pa.RecordBatch | pa.Table]:
            """The cells of t; if it is not the last, the rows of the last cell are given back."""
            lang = t.column("lang").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
            key = lang << 32 | t.column("cell").to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield cell(t.slice(a, b - a)) if last or b < len(key) else t.slice(a, b - a)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) < 1 << 16:
                continue
            for x in whole(pa.concat_tables(held), False):
                if isinstance(x, pa.Table):
                    held = [x]
                else:
                    yield x
        if held:
            yield from whole(pa.concat_tables(held), True)
        release()

    dealt = rows.repartition(tasks_for(rows.sparkSession), "lang", "cell").sortWithinPartitions("lang", "cell", F.col("term").asc_nulls_first())
    return dealt.mapInArrow(run, schema)


def partner(slot, r, m):
    """Whom slot meets in round r of m (odd) rounds among slots 0 to m; each pair of them meets in just one round."""
    straight = F.pmod(r - slot, m)
    middle = F.pmod(r * F.floor((m + 1) / 2), m)  # the slot that would meet itself: it meets m
    return F.when(slot == m, middle).when(straight == slot, m).otherwise(straight).cast("int")


def _meetings(pairs: DataFrame) -> DataFrame:
    """(lang, a, b, value) of pairs(lang, a, b, size, absent_a, vector_a, absent_b, vector_b): summed distances, by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, of_a, of_b = (batch.column(k).to_pylist() for k in (3, 4, 6))
            value = [
                int(np.abs(_unpack(batch.column(5)[k].as_py(), n, of_a[k]) - _unpack(batch.column(7)[k].as_py(), n, of_b[k])).sum())
                for k, n in enumerate(size)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(value, pa.int64())], ["lang", "a", "b", "value"])

    return pairs.mapInArrow(run, "lang string, a string, b string, value long")


def rotate(vectors: DataFrame, rounds: int, per_pass: int = 8) -> DataFrame:
    """(lang, a, b, value), a being the lower slot's group: the distance of every two groups of a language.

    vectors(lang, source, cell, slot, m, size, absent, vector) is durable. per_pass: rounds that are under way at a time.
    """
    tasks = tasks_for(vectors.sparkSession)
    key = ["lang", "cell", "slot"]
    # The residents' partitions are kept for all rounds; what an executor loses is read again from the durable table.
    resident = vectors.select(*key, "size", F.col("source").alias("a"), F.col("absent").alias("absent_a"), F.col("vector").alias("vector_a")).repartition(tasks, *key).persist()
    sums = []
    for low in range(0, rounds, per_pass):
        turn = F.explode(F.sequence(F.lit(low), F.lit(min(low + per_pass, rounds) - 1)))
        moved = vectors.select("lang", "cell", F.col("slot").alias("own"), "m", F.col("source").alias("b"), F.col("absent").alias("absent_b"), F.col("vector").alias("vector_b"), turn.alias("r")).where("r < m")
        moved = moved.withColumn("slot", partner(F.col("own"), F.col("r"), F.col("m"))).where("slot < own").select(*key, "b", "absent_b", "vector_b")
        met = resident.join(moved.repartition(tasks, *key), key).select("lang", "a", "b", "size", "absent_a", "vector_a", "absent_b", "vector_b")
        sums.append(durable(_meetings(met).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))))
    resident.unpersist()
    out = sums[0]
    for s in sums[1:]:
        out = out.unionByName(s)
    return out


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50, cell_terms: int = 4096, cell_entries: int = 1 << 20, per_pass: int = 8) -> DataFrame:
    """(lang, source, part, item, value, rank) over docs(lang, source, text): see the module and op13_divergence.

    Null lang, source and text count as ''. A language without kept terms has all its pairs with value 0. Ties are ordered
    by the item's UTF-8 bytes. Repeated rows count each. An empty table gives no rows; other columns are ignored.
    cell_terms and cell_entries: wanted terms, and terms times groups, in a cell, which bound what meets in a task; per_pass:
    rounds at a time. They change the cost only.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = term_counts(docs).groupBy("lang", "term", "source").agg(F.sum("occ").alias("occ"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    kept = counted.withColumn("in_lang", F.sum("docs").over(of_term)).where(F.col("in_lang") >= least_docs)
    kept = durable(kept.withColumn("first", F.row_number().over(of_term.orderBy("source")) == 1).select("lang", "source", "term", "occ", "first"))

    groups = docs.select("lang", "source").groupBy("lang", "source").agg(F.lit(0).cast("long").alias("occ"), F.lit(0).cast("long").alias("new"))
    sums = groups.unionByName(kept.select("lang", "source", "occ", F.col("first").cast("long").alias("new"))).groupBy("lang", "source")
    lang = Window.partitionBy("lang")
    groups = sums.agg(F.sum("occ").alias("n"), F.sum("new").alias("new"))
    groups = groups.withColumn("n_lang", F.sum("n").over(lang)).withColumn("kept", F.sum("new").over(lang)).withColumn("slot", F.row_number().over(lang.orderBy("source")) - 1)
    many = F.count("*").over(lang)
    groups = durable(groups.withColumn("m", (many - (many + 1) % 2).cast("int")).drop("new"))  # rounds: one less than an even number of slots
    sizes = groups.agg(F.max("kept").alias("kept"), F.max("m").alias("m")).first()
    wanted = max(1, min(cell_terms, cell_entries // ((sizes.m or 0) + 1)))
    cells = max(1, -(-(sizes.kept or 0) // wanted))
    placed = kept.drop("first").withColumn("cell", F.pmod(F.xxhash64("term"), F.lit(cells)).cast("int"))
    used = placed.select("lang", "cell").union(groups.select("lang", F.lit(0).alias("cell"))).distinct()
    lead = used.join(groups.drop("m"), "lang")
    empty = [F.lit(None).cast(kind).alias(c) for c, kind in (("slot", "int"), ("n", "long"), ("n_lang", "long"), ("kept", "long"))]
    rows = placed.select("lang", "cell", "term", "source", "occ", *empty).unionByName(
        lead.select("lang", "cell", F.lit(None).cast("string").alias("term"), "source", F.lit(0).cast("long").alias("occ"), "slot", "n", "n_lang", "kept")
    )
    made = durable(_vectors(rows, top))

    tops = made.where(F.size("terms") > 0).select("lang", "source", F.explode(F.arrays_zip("terms", "values")).alias("x")).select("lang", "source", F.col("x.terms").alias("item"), F.col("x.values").alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    order = ["lang", "source", "part", "item", "value", "rank"]
    tops = tops.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top).withColumn("part", F.lit("term")).select(order)
    many = F.count("*").over(Window.partitionBy("lang", "cell"))
    vectors = made.drop("terms", "values").withColumn("m", (many - (many + 1) % 2).cast("int"))
    if sizes.m is None:
        return tops
    met = rotate(durable(vectors), sizes.m, per_pass).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = met.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    pairs = both.select("lang", "x.*", "value").withColumn("rank", F.row_number().over(ranked)).withColumn("part", F.lit("pair")).select(order)
    return pairs.unionByName(tops)


def op13_divergence(spark, sf_dir: str) -> DataFrame:
    """Each language's sources against each other (part pair) and against their language (part term, ranks to 50).

    Null text, lang and source count as ''; repeated rows count each; ties go by the item's bytes; see audit.
    """
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
