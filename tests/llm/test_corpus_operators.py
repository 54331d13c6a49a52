"""N-gram join, mixing, packing, top-k search, archives and the pipeline."""

from __future__ import annotations

import heapq
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from waybill.functions.small import fresh_path
from waybill.llm import components, mixing, ngram_join, packing, secret_scans, topk_search, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _near_copies(seed: int) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    rows: list[tuple[int | None, str | None]] = [(None, "null id " * 4), (900, None), (901, ""), (902, " \n "), (903, "One"), (904, "one")]
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 150))]
        for _ in range(rng.choice([1, 1, 2, 6, 40])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            text = " ".join(copy)
            if rng.random() < 0.3:
                text += " " + passage
            rows.append((len(rows) + 100 * group, text.upper() if rng.random() < 0.2 else text.replace(" ", "\n", 1)))
    return rows + [rows[8], (rows[8][0], "w1 w2 w3"), (None, rows[9][1])]


class TestNgramJoin:
    @pytest.mark.parametrize("cell_tokens", [ngram_join.CELL_TOKENS, 400])
    def test_against_brute_force(self, spark, cell_tokens):
        rows = _near_copies(4)
        got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), cell_tokens=cell_tokens)
        assert Counter(map(tuple, got.collect())) == Counter(brute.joined(rows))

    def test_empty_tables(self, spark):
        empty = spark.createDataFrame([], "doc_id long, text string")
        assert ngram_join.ngram_components(empty).count() == 0
        blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
        assert sorted(map(tuple, ngram_join.ngram_components(blank).collect())) == [(1, 0, 1), (2, 0, 2)]

    def test_one_document_of_each_group_stays(self, spark):
        rows = [(1, "a b c d e f g h"), (2, "A b c d e f g h"), (2, "A b c d e f g h"), (3, "x y z"), (4, None), (3, "x y z")]
        docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS cls", "2 AS component_id", "3 AS n")
        kept = ngram_join.one_per_component(docs)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]

    @given(
        st.lists(st.lists(st.integers(0, 12), max_size=12).map(lambda x: sorted(set(x))), max_size=12),
        st.integers(1, 6),
    )
    @settings(max_examples=300, deadline=None)
    def test_merge_with_skips_counts_like_a_counter(self, lists, least):
        counts = Counter(x for values in lists for x in values)
        assert dict(ngram_join.often(lists, least)) == {x: c for x, c in counts.items() if c >= least}

    @given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=20), min_size=2, max_size=15))
    @settings(max_examples=200, deadline=None)
    def test_search_finds_every_far_enough_overlap(self, sets):
        index = defaultdict(list)
        for i, s in enumerate(sets):
            for x in s:
                index[x].append(i)
        for s in sets:
            found = ngram_join.candidates([index[x] for x in s], len(s), [len(t) for t in sets], lambda m: False)
            assert set(found) == {i for i, t in enumerate(sets) if 100 * len(s & t) >= 80 * len(s | t)}

    def test_components(self, spark):
        rng = random.Random(2)
        edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)]
        got = components.components(spark.createDataFrame(edges, "a long, b long"))
        up = {x: x for e in edges for x in e if e[0] != e[1]}
        for _ in range(len(edges)):
            for a, b in edges:
                if a != b:
                    up[a] = up[b] = min(up[a], up[b])
        assert dict(map(tuple, got.collect())) == up


class TestMixing:
    MIX = mixing.Mix(
        levels=(("domain", "domain"), ("language", "lang"), ("leaf", "source")),
        weights={"domain": {"a": 3, "z": 0}, "language": {"en": 4}},
        budget_percent=80,
        max_epochs=2,
    )

    def _rows(self, seed):
        rng = random.Random(seed)
        rows = []
        for i in range(300):
            path = (rng.choice("aabz"), rng.choice(["en", "en", "en", "de", ""]), rng.choice(["s0"] * 6 + ["s1", "s2", "s3"]))
            rows.append((i if i else None, path, rng.choice([0, 1, 3, 10, 50, 400])))
        return rows + rows[:4]

    def _frame(self, spark, rows):
        data = [(k, a, b or None, c, " ".join(["w"] * n)) for k, (a, b, c), n in rows]
        return spark.createDataFrame(data, "doc_id long, domain string, lang string, source string, text string")

    @pytest.mark.parametrize("seed", [1, 2])
    def test_against_brute_force(self, spark, seed):
        rows = self._rows(seed)
        got = mixing.selection(self._frame(spark, rows), self.MIX).collect()
        weights = [{"a": 3, "z": 0}, {"en": 4}, {}]
        want = brute.mixture(rows, weights, 80, 2, self.MIX.seed)
        seen = Counter((r.doc_id, (r.domain, r.language, r.leaf), r.n_tokens) for r in got)
        times = Counter(rows)
        # The brute version adds up the copies of rows that repeat: so does the count of results.
        assert seen == want
        assert max(r.epoch for r in got) <= 1 and all(seen[r] <= 2 * times[r] for r in seen)
        assert sum(r.n_tokens for r in got) <= sum(r[2] for r in rows) * 80 // 100

    def test_rows_keep_their_columns_whatever_their_names(self, spark):
        rows = self._rows(3)
        docs = self._frame(spark, rows).selectExpr("*", "1 AS _row", "2 AS tokens", "3 AS _epoch", "4 AS _key")
        got = mixing.mixed(docs, self.MIX)
        assert got.columns == docs.columns
        assert got.count() == mixing.selection(self._frame(spark, rows), self.MIX).count()

    def test_no_tokens_and_no_rows(self, spark):
        docs = self._frame(spark, [(1, ("a", "en", "s"), 0)])
        assert mixing.selection(docs, self.MIX).count() == 1
        assert mixing.selection(docs.limit(0), self.MIX).count() == 0
        assert mixing.mixed(docs.limit(0), self.MIX).count() == 0


class TestPacking:
    @given(st.lists(st.integers(1, 64), max_size=60))
    @settings(max_examples=200, deadline=None)
    def test_against_a_plain_best_fit(self, lengths):
        lengths.sort(reverse=True)
        capacities = (8, 16, 32, 64)
        assert packing.pack(lengths, capacities) == brute.best_fit(lengths, capacities, packing.attention_cost)

    def test_production_lengths_open_larger_bins_and_shrink_some(self):
        def total(packed):
            return sum(map(packing.attention_cost, packed[1]))

        even = [300] * 300
        assert packing.cheapest(even)[1] == [1024] * 100
        assert total(packing.cheapest(even)) < total(packing.pack(even))
        rng = random.Random(4)
        lengths = sorted((rng.randint(250, 4000) for _ in range(300)), reverse=True)
        opened = []

        def watched(*given):
            opened.append(choose(*given))
            return opened[-1]

        choose, packing.opened_by_fill = packing.opened_by_fill, watched
        try:
            places, final = packing.pack(lengths, by_fill=True)
        finally:
            packing.opened_by_fill = choose
        assert total((places, final)) <= total(packing.pack(lengths))
        first = {}
        for n, (b, _) in zip(lengths, places, strict=True):
            first.setdefault(b, n)
        least = [min(c for c in packing.CAPACITIES if c >= first[b]) for b in range(len(final))]
        assert any(o > m for o, m in zip(opened, least, strict=True))
        assert any(f < o for f, o in zip(final, opened, strict=True))

    def test_every_token_is_placed_once(self, spark):
        rng = random.Random(6)
        rows = [(i if i % 17 else None, " ".join("w" for _ in range(rng.choice([0, 1, 5, 40, 100, 700])))) for i in range(200)]
        rows += [(7, None)] * 3 + [(8, "w w w")] * 120
        docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS piece", "3 AS block")
        got = packing.packed(docs, capacities=(16, 64, 128), block_pieces=40).toPandas()
        placed = got[got["n_tokens"] > 0]
        # Offsets of a bin follow each other, and its length is the least that holds it.
        for _, b in placed.sort_values("bin_offset").groupby("bin_id"):
            used = b["n_tokens"].tolist()
            assert b["bin_offset"].tolist() == np.cumsum([0, *used[:-1]]).tolist()
            assert b["capacity"].nunique() == 1
            assert b["capacity"].iloc[0] == min(c for c in (16, 64, 128) if c >= sum(used))
        total = Counter()
        for r in got.fillna({"doc_id": -1}).itertuples():
            total[int(r.doc_id)] += r.n_tokens
        want = Counter()
        for key, text in rows:
            want[-1 if key is None else key] += len(brute.words(text))
        assert +total == +want
        assert (got["n_tokens"] == 0).sum() == sum(not brute.words(t) for _, t in rows)
        for key, pieces in got[got["doc_id"] == 3].groupby("doc_id"):
            ends = pieces.sort_values("token_start")
            assert ends["token_start"].tolist() == np.cumsum([0, *ends["n_tokens"].tolist()[:-1]]).tolist()

    def test_empty_table(self, spark):
        assert packing.packed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


class TestTopK:
    SCHEMA = "vec_id long, embedding array<float>"

    def want(self, rows, k, asks):
        good = []
        for key, v in rows:
            if key is not None and v and all(x is not None and np.isfinite(x) for x in v):
                good.append((key, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
        out = Counter()
        for q, a in (x for x in good if asks(x[0])):
            scores = []
            for c, b in good:
                if c != q and len(a) == len(b):
                    exact = sum(x * y for x, y in zip(a, b, strict=True))
                    scores.append((-max(-(2**63), min(2**63 - 1, exact)), c))
            for rank, (score, c) in enumerate(sorted(scores)[:k], 1):
                out[(q, rank, c, -score)] += 1
        return out

    def test_against_brute_force(self, spark, monkeypatch):
        monkeypatch.setattr(topk_search, "BLOCK_VECTORS", 60)
        monkeypatch.setattr(topk_search, "LIST_VECTORS", 25)
        monkeypatch.setattr(topk_search, "CHUNK_QUERIES", 7)
        rng = random.Random(9)
        rows = [(i, [rng.choice([-0.01, 0.0, 0.01, 0.5, rng.gauss(0, 1)]) for _ in range(6)]) for i in range(220)]
        rows += [(300, None), (301, []), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (303, [float("nan")] * 6), (304, [float("inf")] * 6)]
        rows += [(None, [1.0] * 6), (310, [0.0] * 6), (311, [-0.0] * 6), (312, [1.0, 2.0]), (330, [2.0, 1.0]), rows[10], rows[11]]
        rows += [(331, [9.0] * 6)] * 3 + [(332, [8.0] * 6)] * 9 + [(20, [1.0] * 6)] + [(40, rows[40][1])] * 2
        frame = spark.createDataFrame(rows, self.SCHEMA).selectExpr("*", "1 AS block", "2 AS score")
        got = topk_search.top_k(frame, F.col("vec_id") % 10 == 0)
        assert Counter(map(tuple, got.collect())) == self.want(rows, 5, lambda i: i % 10 == 0)

    def test_large_components_and_small_tables(self, spark):
        rows = [(0, [1e9, 3.0]), (1, [2e9, 1.0]), (2, [3e38, 0.0]), (3, [-3e38, 0.0])] + [(i, [i / 7, -i / 9]) for i in range(4, 30)]
        frame = spark.createDataFrame(rows, self.SCHEMA)
        got = topk_search.top_k(frame, F.col("vec_id") == 5)
        assert Counter(map(tuple, got.collect())) == self.want(rows, 5, lambda i: i == 5)
        few = topk_search.top_k(frame, F.col("vec_id").isin(1, 9))
        assert Counter(map(tuple, few.collect())) == self.want(rows, 5, lambda i: i in (1, 9))
        got = topk_search.top_k(frame, F.lit(True))
        assert Counter(map(tuple, got.collect())) == self.want(rows, 5, lambda i: True)
        assert topk_search.top_k(frame.limit(0), F.lit(True)).count() == 0
        assert topk_search.top_k(frame, F.lit(False)).count() == 0

    def test_repeated_rows_as_in_sql(self, spark, tmp_path):
        rows = [(50 * (i % 2) + i, [i / 3, -i / 5, float(i % 4)]) for i in range(60)]
        rows += [rows[3]] * 2 + [rows[50]] + [rows[59]] * 7 + [(100, [0.5, 0.5, 0.5]), (100, [0.5, 0.0, 0.5]), (7, None), (8, [])]
        spark.createDataFrame(rows, self.SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
        got = Counter(map(tuple, topk_search.op8(spark, str(tmp_path)).collect()))
        assert got == Counter(con.sql(topk_search.OP8_SQL).fetchall())
        assert got == self.want(rows, 5, lambda i: i % 50 == 0)

    def test_reading_in_order_equals_scoring_all(self):
        rng = np.random.default_rng(1)
        for _ in range(40):
            values = np.floor(rng.normal(0, 20, (450, 8))) // 4
            ids = rng.permutation(450)
            query = np.floor(rng.normal(0, 20, 8)) // 4
            scores = sorted((-int(s), int(i)) for s, i in zip(values @ query, ids, strict=True) if i != 3)[:5]
            found, share = [], 0.1
            for a in range(0, 450, 150):
                found, share = topk_search.SortedLists(ids[a : a + 150], values[a : a + 150]).best(query, 3, 5, found, share)
            assert found == [(i, -s) for s, i in scores]


class TestWarc:
    PAGES = "page_id long, url string, html string"

    def _pages(self):
        big = "<p>é🙂</p>\r\n\r\nWARC/1.1\r\n" * 60
        rows = [(i, f"http://h{i % 3}.example.com:80/p/{i % 7}", f"page {i} " * (i * 4)) for i in range(60)]
        rows += [(100, "https://A.b.C/x", big), (101, "https://a.b.c/x", big), (103, None, big), (None, "http://n.x", big)]
        rows += [(110, "no scheme\r\nX: y", None), (111, "", ""), (112, "http://e.x", "small"), (113, "http://e.x", "small")]
        return rows + [(103, "http://again.x/", big), (120, "http://l.x/", "z" * 70000), (2**62, "http://m.x/", "m"), (-5, "http://m.x/", None)]

    def want(self, rows):
        import hashlib

        groups = defaultdict(list)
        for key, _, html in rows:
            groups[html or ""].append(key)
        out = Counter()
        for key, _, html in rows:
            data = (html or "").encode()
            first = max((k for k in groups[html or ""] if k is not None), default=None)
            other = len(data) >= 1000 and first is not None and key != first
            out[(key, len(data), hashlib.sha1(data).hexdigest(), "revisit" if other else "response", first if other else None)] += 1
        return out

    def test_one_archive_is_sorted_by_capture_time(self, spark):
        ids = [2**62, -5, 10**9 + 3, 7, 3, -(10**9), None, 10**9]
        pages = spark.createDataFrame([(i, "http://m.x/a", "m") for i in ids], "page_id long, url string, html string")
        path = fresh_path(spark)
        warc.write_archives(pages.coalesce(1), path)
        got = [(r.captured, r.page_id) for r in warc.merged_index(warc.read_runs(spark, path)).collect()]
        assert len(got) == len(ids)
        assert got == sorted(got, key=lambda x: (x[0], x[1] is not None, x[1] or 0))

    @pytest.mark.parametrize("compression", ["gzip", "none"])
    def test_round_trip(self, spark, compression, monkeypatch):
        monkeypatch.setattr(warc, "SMALL_RECORDS", 7)
        rows = self._pages()
        pages = spark.createDataFrame(rows, self.PAGES).repartition(5).selectExpr("*", "1 AS bytes", "2 AS digest")
        path = fresh_path(spark)
        warc.write_archives(pages, path, compression)
        runs = warc.read_runs(spark, path)
        index = warc.merged_index(runs)
        got = index.collect()
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == self.want(rows)
        assert all(r.intact for r in got)
        keys = [(r.url_key, r.captured, -1 if r.page_id is None else r.page_id) for r in got]
        assert keys == sorted(keys)
        assert {r.url_key for r in got} >= {"c,b,a)/x", "com,example,h0)/p/0"}
        for _, run in pd.DataFrame([r.asDict() for r in runs.collect()]).groupby("archive"):
            order = run.sort_values("entry_no")["url_key"].tolist()
            assert order == sorted(order) and len(order) <= 16

    def test_history_of_a_hot_url_over_many_ranges(self, spark, monkeypatch):
        monkeypatch.setattr(warc, "RANGE_ENTRIES", 40)
        rng = random.Random(9)
        rows = [(rng.randint(0, 900), f"http://h{max(0, rng.randint(-20, 6))}.org/", f"x{i}") for i in range(500)]
        rows += [(None, "http://h0.org/", "a"), (None, "http://h0.org/", "b"), (5, None, "c")]
        got = warc.archived(spark.createDataFrame(rows, self.PAGES).repartition(6))
        assert got.rdd.getNumPartitions() > 1
        captures = sorted((r.url_key, r.captured, -1 if r.page_id is None else r.page_id) for r in got.collect())
        want = Counter()
        for key in captures:
            place = 1 + sum(c[0] == key[0] and c < key for c in captures)
            want[(*key, place)] += 1
        assert Counter((r.url_key, r.captured, -1 if r.page_id is None else r.page_id, r.history_no) for r in got.collect()) == want

    def test_empty_table(self, spark):
        assert warc.archived(spark.createDataFrame([], self.PAGES)).count() == 0

    @given(st.lists(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 3))).map(sorted), max_size=9))
    @settings(max_examples=300, deadline=None)
    def test_loser_tree_merges(self, runs):
        got = list(warc.LoserTree(runs))
        assert [runs[r][i] for r, i in got] == list(heapq.merge(*runs))
        assert len(set(got)) == sum(map(len, runs))


class TestPipeline:
    def _rows(self):
        rng = random.Random(11)
        rows = []
        for i in range(160):
            text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", f"u{i}", f"v{i}"]) + str(rng.randint(0, 300)) for _ in range(rng.randint(4, 200)))
            if i % 9 == 0:
                text += ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
            rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src1", "src2", "src7"]), len(text)))
        rows += [(200 + i, rows[i][1] + " end", *rows[i][2:]) for i in range(0, 40, 2)]
        return rows + [(300, None, "en", "src1", None), (301, "x " * 5, "en", "src1", 10), (302, "dup line here\n" * 40, "en", "src2", 1)]

    def test_against_brute_force(self, spark, tmp_path):
        rows = self._rows()
        spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
        kept = [r for r in rows if brute.quality(r[1])["kept"]]
        component = brute.joined([(r[0], r[1]) for r in kept])
        kept = [r for r, (key, _, least) in zip(kept, component, strict=True) if key == least]
        clean = {r[0]: secret_scans._masked(r[1], secret_scans.scan(r[1]), "[SECRET]") for r in kept}
        assert any("[SECRET]" in t for t in clean.values())
        mix = mixing.MIX
        leveled = [
            (r[0], (f"d{int(r[3].removeprefix('src')) % 4}", r[2] or "", r[3]), len(brute.words(clean[r[0]]))) for r in kept
        ]
        weights = [mix.weights["domain"], mix.weights["language"], {}]
        copies = brute.mixture(leveled, weights, mix.budget_percent, mix.max_epochs, mix.seed)
        want = Counter()
        for (key, _, tokens), n in copies.items():
            want[key] += n * tokens
        got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
        assert Counter(got.groupby("doc_id")["n_tokens"].sum().to_dict()) == +want
        for _, b in got[got["n_tokens"] > 0].groupby("bin_id"):
            assert b["capacity"].iloc[0] == min(c for c in packing.CAPACITIES if c >= b["n_tokens"].sum())

    def test_stages_take_an_empty_table_and_keep_columns(self, spark):
        docs = spark.createDataFrame([], DOCS)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0
