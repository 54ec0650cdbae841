"""The registered queries on the smallest tables against brute force, and SQL where there is some."""

import collections
import hashlib
import zlib
from pathlib import Path

import brute
import duckdb
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
Q, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def docs():
    return [(r["doc_id"], r["text"]) for r in pq.read_table(DATA / "documents.parquet").to_pylist()]


def rows(spark, name):
    return [tuple(r) for r in Q[name](spark, str(DATA)).collect()]


def test_op1(spark, docs):
    kinds, got = ("email", "ip", "card", "phone"), {r[0]: r[1:] for r in rows(spark, "op1_personal_data")}
    for doc, text in docs:
        base = brute.base_spans(text)
        shown = [f"{kinds[k]}:{a}:{b}" for a, k, b in base]
        assert got[doc][:4] == tuple(sum(k == j for _, k, _ in base) for j in range(4))
        assert got[doc][4] == hashlib.sha256(",".join(shown).encode()).hexdigest()
        spans = got[doc][5].split(",") if got[doc][5] else []
        assert set(shown) <= set(spans)
        order = [(int(s.split(":")[1]), kinds.index(s.split(":")[0])) for s in spans]
        assert order == sorted(order)


def test_op2(spark, docs):
    want = []
    for doc, text in docs:
        n = len(brute.ids_of("byte_bpe_50k.json", text))
        want.append((doc, len((text or "").encode()), n, n > 512))
    assert sorted(rows(spark, "op2_token_counts")) == sorted(want)


def test_op3(spark, docs):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(DATA / "benchmark.parquet").to_pylist()]
    want = brute.contamination(docs, items)
    assert any(w[5] for w in want)
    assert sorted(rows(spark, "op3_benchmark_decontamination")) == sorted(want)


def test_op5(spark, docs):
    assert sorted(rows(spark, "op5_simhash_near_dedup")) == sorted(brute.near_components(docs))


def test_op6(spark):
    pages = pq.read_table(DATA / "pages.parquet").to_pylist()
    got = {r[0]: r[1:] for r in rows(spark, "op6_html_main_text")}
    assert len(got) == len(pages)
    for p in pages:
        url, text, n = got[p["page_id"]]
        assert url == p["url"] and n == len(text)
        for outside in ("<nav>", "<footer>", '<div class="ad">', "<script>"):
            part = p["html"].split(outside)[1].split("<")[0].strip()
            assert len(part) < 30 or part not in text
        inside = p["html"].split("<article>")[1].split("</article>")[0]
        longest = max((s for s in inside.replace(">", "<").split("<") if "&" not in s), key=len)
        assert " ".join(longest.split()) in text


def test_op7(spark, docs):
    assert sorted(rows(spark, "op7_token_ids_orc")) == brute.stored_ids(docs)


def test_op9(spark, docs):
    got, want = rows(spark, "op9_best_fit_packing"), brute.pieces(docs)
    assert {(r[0], r[1]): r[2:5] for r in got} == want
    check_sequences(got, 2048)
    total = sum(size for _, size, _ in want.values())
    assert len({r[5] for r in got}) <= 1.02 * total / 2048 + 1


def check_sequences(got, capacity):
    held = collections.defaultdict(list)
    for r in got:
        held[r[5]].append((r[6], r[3]))
    for parts in held.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= capacity


def test_op10(spark):
    got = {r[0]: r[1:] for r in rows(spark, "op10_language_id")}
    table = pq.read_table(DATA / "documents.parquet").to_pylist()
    assert len(got) == len(table)
    right = [got[r["doc_id"]][1] == r["lang"] for r in table if got[r["doc_id"]][0]]
    assert all(0 <= s <= 1 for _, _, s in got.values())
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, (h, _, _) in got.items())
    assert sum(right) >= 0.97 * len(right)


def test_pipeline(spark, docs):
    got = rows(spark, "pipeline")
    items = [(r["item_id"], r["text"]) for r in pq.read_table(DATA / "benchmark.parquet").to_pylist()]
    left = [(d, t) for d, t in docs if any(c.isalpha() for c in t or "")]
    kept = {r[0] for r in brute.exact_groups(left) if r[3]}
    left = [(d, t) for d, t in left if d in kept]
    kept = {d for d, _, root in brute.near_components(left) if d == root}
    left = [(d, t) for d, t in left if d in kept]
    bad = {r[0] for r in brute.contamination(left, items) if r[5]}
    left = [(d, t) for d, t in left if d not in bad]
    assert bad
    assert {(r[0], r[1]): r[2:5] for r in got} == brute.pieces(left)
    check_sequences(got, 2048)


@pytest.mark.parametrize("name", sorted(n for n in SQL if n.startswith("op")))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    got = Q[name](spark, str(DATA)).select(*columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
