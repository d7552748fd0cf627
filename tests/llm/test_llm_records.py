"""Chat formatting, WARC archives, nearest neighbours and sharding."""

import gzip
import hashlib
import json
import random
import zlib

import duckdb
import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

import __spark_entry__ as entry
from barspark.llm import ann, chat, sharding, warc
from barspark.llm.common import stage
from checks.compare import rows_of

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, table", [("op1_prefix_targets", "conversations"), ("op4_gzip_members", "pages")])
def test_against_sql(spark, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = entry.queries()[name](spark, SF)
    res = con.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in res.description], res.fetchall())


# ---------------------------------------------------------------- chat

ODD = ["</s>", "<\\/s>", "<s>[INST]", "[\\/INST] [INST", "<<SYS>> <</SYS>> <\\<SYS>>", "<</s>", "[[INST]]", "\\", "a\nb", "", "\U0001f600 é", "<", "[", "</s", "<\\\\/s>\\"]


def test_any_text_comes_back(spark):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["<", "[", "\\", "/", "s>", "INST]", "SYS>>", "a"]) for _ in range(12)) for _ in range(300)]
    rows = [(i // 5, i % 5, rng.choice(["user", "assistant", *ODD]), t, "c", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string, number int").repartition(3)
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.format_conversations(df).select("conv_id", chat.turns_of(F.col("formatted")).alias("turns")).collect()}
    for c in {r[0] for r in rows}:
        assert back[c] == [(r[2], r[3]) for r in rows if r[0] == c]


def test_examples_and_odd_rows(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "user", "U"), (1, 2, "assistant", "</s>A"), (1, 3, "user", None), (1, 4, "assistant", "B" * 100_000), (2, 0, "user", "only"),
            (3, None, "assistant", "x"), (3, None, "assistant", "x"), (3, None, None, "y"), (None, 0, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ex = {(r.conv_id, r.example): r for r in chat.expand_prefixes(df).collect()}
    assert set(ex) == {(1, 1), (1, 2), (3, 1), (3, 2), (None, 1)}
    one, two = ex[1, 1], ex[1, 2]
    assert one.text == "<s>system[INST]S</s><s>user[INST]U</s><s>assistant[INST]<\\/s>A</s>" and one.text[one.loss_start:one.loss_end] == "<\\/s>A"
    assert two.text.startswith(one.text) and two.text[two.loss_start:two.loss_end] == "B" * 100_000
    d = {r.conv_id: r for r in chat.digests(chat.format_conversations(df), chat.expand_prefixes(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (d[1].n_turns, d[1].loss_sha256, d[1].loss_chars) == (5, sha("</s>A" + "B" * 100_000), 100_005)
    assert (d[2].loss_chars, d[2].loss_sha256, d[2].turns_sha256) == (0, sha(""), sha("user\nonly\n"))
    assert d[3].n_turns == 3 and d[3].turns_sha256 == sha("\ny\nassistant\nx\nassistant\nx\n") and d[None].n_turns == 1
    none = spark.createDataFrame([], df.schema)
    assert chat.digests(chat.format_conversations(none), chat.expand_prefixes(none)).count() == 0


# ---------------------------------------------------------------- WARC


def test_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 777)
    big = "é" * 700 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
    rows = [(1, "http://a/ü b\r\nX: 1", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (7, "u", big), (7, "u", big), (None, "u", big), (8, "u", "z" * 300_000), (9, "u", "q" * 1000), (10, "u", "q" * 1000)]
    df = spark.createDataFrame([(*r, "f", 1) for r in rows], "page_id long, url string, html string, file string, ordinal int").repartition(3)
    written = stage(warc.write_monoliths(df, f"{tmp_path}/whole"))
    done = stage(warc.normalise(written, warc.find_revisits(written), f"{tmp_path}/whole", f"{tmp_path}/members", 2))
    got = warc.read_back(done, f"{tmp_path}/members", 2).collect()
    size = len(big.encode())
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        to = {size: 7, 1000: 10}.get(len(raw))
        again = to is not None and to != page
        want.append((str(page), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", to if again else None))
    assert sorted(((str(r.page_id), *r[1:5]) for r in got), key=str) == sorted(want, key=str)
    for f in {r.file for r in got}:  # the whole file, member by member, is what the index says
        data = (tmp_path / "members" / f).read_bytes()
        at = 0
        for line in (tmp_path / "members" / f"{f}.idx").read_text().splitlines():
            e = json.loads(line)
            assert e["offset"] == at
            z = zlib.decompressobj(31)
            assert z.decompress(data[at:at + e["length"]]).startswith(b"WARC/1.1\r\n") and z.eof and not z.unused_data
            at += e["length"]
        assert at == len(data) and gzip.decompress(data).count(b"WARC-Record-ID") > 0
    for f in written.select("file").distinct().collect():
        z = zlib.decompressobj(31)
        z.decompress((tmp_path / "whole" / f.file).read_bytes())
        assert z.eof and not z.unused_data  # one member for the whole file


def test_no_pages(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    written = stage(warc.write_monoliths(df, f"{tmp_path}/w"))
    done = stage(warc.normalise(written, warc.find_revisits(written), f"{tmp_path}/w", f"{tmp_path}/m", 0))
    assert warc.read_back(done, f"{tmp_path}/m", 0).count() == 0


# ---------------------------------------------------------------- nearest neighbours


def brute(ids, x, queries, k):
    out = {}
    for i in queries:
        s = (x * x[i]).sum(axis=1)
        s[i] = -np.inf
        best = np.lexsort((ids, -s))[:min(k, len(x) - 1)]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in best]
    return out


def test_all_parts_probed_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 8)).astype(np.float32).astype(float)
    x[50:150] = x[50]  # a hot vector
    ids = np.arange(400)
    rows = [(int(i), v.tolist(), 1, "p") for i, v in zip(ids, x)]
    rows += [(1000, None, 1, "p"), (1020, [0.0] * 8, 1, "p"), (1040, [float("nan")] * 8, 1, "p"), (1060, [None] * 8, 1, "p"), (1080, [1.0], 1, "p"), (None, [1.0] * 8, 1, "p"), (20, x[20].tolist(), 1, "p")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int, part string")
    got = ann.search(df, F.col("vec_id") % 20 == 0, k=20, parts=8, recall=2.0, block=60, queries=7).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert by == brute(ids, x, range(0, 400, 20), 20)


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, ann.search(df, F.col("vec_id") % 20 == 0).collect()))
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert ann.search(df.limit(1), F.lit(True)).count() == 0
    assert ann.search(df.limit(0), F.lit(True)).count() == 0
    assert ann.search(df, F.lit(False)).count() == 0


def test_bisection_is_balanced_and_keeps_clusters():
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((4, 16)) * 5
    x = np.concatenate([c + rng.standard_normal((100, 16)) for c in centre])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = ann.neighbour_graph(x)
    part = ann.bisect(graph, 4)
    assert np.bincount(part).tolist() == [100] * 4
    assert (part[graph] == part[:, None]).mean() > 0.9


def test_recall(spark):
    got = entry.queries()["op9_learned_partitions"](spark, SF).collect()
    e = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in e]), np.array([r.embedding for r in e], float)
    want = brute(ids, x, np.nonzero(ids % 20 == 0)[0], 20)
    near = {}
    for r in got:
        near.setdefault(r.query_id, set()).add(r.vec_id)
    assert len(got) == 20 * len(want)
    assert sum(len(near[q] & {i for i, _ in w}) for q, w in want.items()) / len(got) >= 0.9


# ---------------------------------------------------------------- sharding


def plain_fill(shards, size):
    names = sorted(shards)
    prefs = {s: [(xxhash.xxh64(s, seed=1).intdigest() % size + j * (xxhash.xxh64(s, seed=2).intdigest() % (size - 1) + 1)) % size for j in range(size)] for s in names}
    table = {}
    while len(table) < size:
        for s in names:
            free = next((p for p in prefs[s] if p not in table), None)
            if free is not None:
                table[free] = s
    return [table[i] for i in range(size)]


def test_table():
    shards = [f"s{i}" for i in (3, 1, 4, 15, 9, 2, 6)]
    assert [shards[i] for i in sharding.fill(shards, 101)] == plain_fill(shards, 101)
    t = sharding.fill(shards, 65_537)
    assert max(np.bincount(t)) - min(np.bincount(t)) <= 1
    fewer = sharding.fill(shards[:-1], 65_537)
    moved = sum(shards[a] != shards[b] for a, b in zip(t, fewer) if a != 6)
    assert moved < 0.1 * 65_537
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8), (["a"] * 3, 2)):
        with pytest.raises(ValueError):
            sharding.fill(*bad)


def test_place(spark, tmp_path):
    names = ["a", "b", "c"]
    df = spark.createDataFrame([(i, "x", 1) for i in range(200)] + [(None, "x", 1), (7, "x", 1), (7, None, 1)], "doc_id long, _slot string, i int")
    got = sharding.place(df, F.col("doc_id"), names, 251)
    assert got.columns == [*df.columns, "slot", "shard"] and got.count() == 203
    table = plain_fill(names, 251)
    for r in got.collect():
        h = int(np.uint64(xxhash.xxh64("" if r.doc_id is None else str(r.doc_id), seed=42).intdigest()).astype(np.int64))
        assert r.slot == h % 251 and r.shard == table[r.slot]
    with pytest.raises(ValueError):
        sharding.place(got, F.col("doc_id"), names, 251)
    sharding.write_shards(got, f"{tmp_path}/out", rows_per_file=50)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 203
    assert sharding.place(df.limit(0), F.col("doc_id"), names, 251).count() == 0


def test_sharded_query(spark):
    got = entry.queries()["op10_lookup_sharding"](spark, SF).toPandas()
    assert len(got) == 1000 and got.groupby("doc_id").shard.nunique().max() == 1
