"""Ranked lexical search, URL filters and the Merkle manifest."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waybill.llm import manifest, ranked_search, url_filters


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


class TestRankedSearch:
    TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def want(self, docs, items, k=10):
        held = [(i, self.TERM.findall(lower(t))) for i, t in docs]
        held = [(i, t) for i, t in held if t]
        n_docs, length = len(held), sum(len(t) for _, t in held)
        df = Counter(w for _, t in held for w in set(t))
        out = Counter()
        for item, text in items:
            scores = []
            asked = set(self.TERM.findall(lower(text)))
            for i, t in held:
                tf, m = Counter(t), 10 + 90 * len(t) * n_docs // length
                score = sum(
                    math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 8 * m))
                    for w in asked if w in tf
                )
                if score > 0:
                    scores.append((-score, i is None, i or 0))
            for rank, (score, null, i) in enumerate(sorted(scores)[:k], 1):
                out[(item, rank, None if null else i, -score)] += 1
        return out

    def rows(self, seed):
        rng = random.Random(seed)
        words = [f"w{i}" for i in range(60)] + ["Ünï", "straße", "ÀB", "a1"]
        text = lambda n: rng.choice([" ", "\n", "--", "\x00", "[", "é "]).join(rng.choice(words) for _ in range(n))
        docs = [(rng.randrange(400), text(rng.choice([1, 3, 30, 80]))) for _ in range(150)]
        docs += [docs[0]] * 15 + [(None, docs[1][1]), (None, docs[1][1]), (700, None), (701, ""), (702, "!? ~"), (703, "W1 " * 40_000)]
        items = [(i, text(rng.randint(1, 12))) for i in range(20)]
        items += [items[0], (0, "w3 W3 w3"), (None, "w5"), (50, None), (51, "..."), (52, "unheard of"), (53, text(3_000))]
        return docs, items

    @pytest.mark.parametrize("seed, sizes", [(1, {}), (2, {"ITEM_TILE": 3, "TERM_TILE": 4, "DOC_TILE": 7, "BAND": 1, "GROUP_BYTES": 4_000})])
    def test_against_brute_force(self, spark, monkeypatch, seed, sizes):
        for name, value in sizes.items():
            monkeypatch.setattr(ranked_search, name, value)
        docs, items = self.rows(seed)
        documents = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS terms", "2 AS score").repartition(3)
        asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS rank", "'y' AS key")
        got = ranked_search.ranked_search(documents, asked)
        assert Counter(map(tuple, got.collect())) == self.want(docs, items)

    def test_empty_tables(self, spark):
        docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
        items = spark.createDataFrame([(1, "a")], "item_id long, text string")
        assert ranked_search.ranked_search(docs.limit(0), items).count() == 0
        assert ranked_search.ranked_search(docs, items.limit(0)).count() == 0
        assert ranked_search.ranked_search(docs, spark.createDataFrame([(1, "!")], "item_id long, text string")).count() == 0
        assert [tuple(r) for r in ranked_search.ranked_search(docs, items).collect()] == list(self.want([(1, "a b")], [(1, "a")]))

    def test_tiles_stay_exact(self):
        """The largest weights and impacts there are: tiles narrow until their sums fit a double."""
        count = 3_000
        weights = np.full(count, 60_000_000, np.int64)
        items = ranked_search.Items([np.arange(count)], weights, 10, 10)
        assert items.width * 60_000_000 * 10**6 < 2**53
        term, doc = np.tile(np.arange(count), 2), np.repeat([0, 1], count)
        impact = np.concatenate([np.full(count, 999_999), np.full(count, 999_998)])
        scores = ranked_search._tile_scores(items, items.item_terms, term, doc, impact, 2)
        assert scores.tolist() == [[count * 60_000_000 * 999_999, count * 60_000_000 * 999_998]]

    @given(st.lists(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9), st.booleans()), min_size=1, max_size=9), max_size=8), st.integers(1, 4))
    @settings(max_examples=200, deadline=None)
    def test_best_of_tiles_is_best_of_all(self, tiles, k):
        best, want = ranked_search.Best(1, k), []
        for tile in tiles:
            best.add(np.array([[s for s, _, _ in tile]]), np.array([d for _, d, _ in tile]), np.array([n for _, _, n in tile]))
            want += [(-s, n, d) for s, d, n in tile if s > 0]
        assert [(-s, n, d) for s, n, d in zip(best.score, best.null, best.doc, strict=True)] == sorted(want)[:k]


class TestUrlFilters:
    def split(self, url):
        if url is None or "://" not in url:
            return "", ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        return lower(host), path

    def rule(self, host, path):
        fits = []
        for name, _ in url_filters.RULES:
            of, _, start = name.partition("/")
            if (host == of or host.endswith("." + of)) and path.startswith("/" + start):
                fits.append(name)
        return max(fits, key=len, default=None)

    def shape(self, segment):
        stem, ending = re.match(r"(.*?)(\.[A-Za-z]{1,5})?$", segment, re.S).groups()
        return self.stem(stem) + lower(ending)

    def stem(self, stem):
        if re.fullmatch("[0-9]+", stem):
            return "{num}"
        return "{hex}" if re.fullmatch("[0-9A-Fa-f-]{8,}", stem) and re.search("[0-9]", stem) else "{slug}"

    def named(self, values):
        """Name of each literal value; values: (next shape or end, label) of the pages of each."""
        total = sum(map(len, values.values()))
        kept = {v: p for v, p in values.items() if v and len(p) >= url_filters.LITERAL_PAGES and len(p) >= url_filters.LITERAL_SHARE * total}
        bound = math.sqrt(0.5 * math.log(2 / url_filters.MERGE_ALPHA))
        groups = []
        for value, pages in sorted(kept.items(), key=lambda x: (-len(x[1]), x[0])):
            for names, pool in groups:
                tests = [lambda p, f=f: p[0] == f for f in ("end", "{num}", "{hex}", "{slug}")] + [lambda p, x=x: p[1] == x for x in (0, 1)]
                limit = bound * (1 / math.sqrt(len(pool)) + 1 / math.sqrt(len(pages)))
                if all(abs(sum(map(t, pool)) / len(pool) - sum(map(t, pages)) / len(pages)) <= limit for t in tests):
                    names.append(value)
                    pool.extend(pages)
                    break
            else:
                groups.append(([value], list(pages)))
        return {n: "|".join(sorted(names)) for names, _ in groups for n in names}

    def want(self, rows):
        pages, words = [], set(url_filters.BLOCK_WORDS)
        for key, url in rows:
            host, path = self.split(url)
            rule = self.rule(host, path)
            verdict = dict(url_filters.RULES).get(rule)
            worded = words & set(re.split("[^a-z]+", (host + "/" + path).lower()))
            label = 0 if verdict == "allow" else 1 if worded else None
            pages.append([key, host, path, rule, verdict, label, path[1:].split("/") if path else [], ""])
        hosts = defaultdict(list)
        for p in pages:
            if p[1]:
                hosts[p[1]].append(p)
        for members in hosts.values():
            for level in range(url_filters.MAX_LEVELS):
                nodes = defaultdict(lambda: defaultdict(list))
                for p in members:
                    if len(p[6]) > level:
                        after = p[6][level + 1] if len(p[6]) > level + 1 else ""
                        going = self.stem(re.sub(r"\.[A-Za-z]{1,5}$", "", after)) if after else "end"
                        nodes[p[7]][p[6][level]].append((going, p[5]))
                names = {node: self.named(values) for node, values in nodes.items()}
                for p in members:
                    if len(p[6]) > level:
                        s = p[6][level]
                        p[7] += "/" + names[p[7]].get(s, self.shape(s) if s else "")
            for p in members:
                p[7] += ("/{more}" if len(p[6]) > url_filters.MAX_LEVELS else "") + "$"

            def labels(start):
                of = [p[5] for p in members if start is None or (p[7] + "/").startswith(start + "/")]
                return of.count(1), of.count(0)

            for p in members:
                purity, parts = 0.5, p[7].split("/")
                for start in [None, *("/".join(parts[:i]) for i in range(1, len(parts) + 1))]:
                    bad, good = labels(start)
                    purity = (bad + url_filters.PRIOR * purity) / (bad + good + url_filters.PRIOR)
                same = [x[5] for x in members if x[7] == p[7]]
                reject = same.count(1) >= url_filters.LABELLED_SHARE * len(same) and purity >= url_filters.PURITY
                p[4] = p[4] or ("block" if reject else "allow")
        return Counter((p[0], p[1], p[2], p[3], p[4] or "allow", p[7] if p[1] else None) for p in pages)

    def rows(self):
        rng = random.Random(3)
        rows = []
        hosts = ["a.example.com", "casino.example.com", "shop.example.org", "example.net", "x.net", "B.Example.COM"]
        for i in range(900):
            host = rng.choice([*hosts, *hosts[:3] * 3])
            first = rng.choice(["en", "fr", "de", "blog", "p"])
            rest = {
                "blog": rng.choice(["2020", "2021", "poker", f"t{rng.randrange(9)}"]) + f"/{rng.choice(['a', 'story', 'x-y'])}-{rng.randrange(99)}.HTML",
                "p": rng.choice([f"{rng.getrandbits(40):010x}", "ads/" + str(rng.randrange(50)), ""]),
            }.get(first, str(rng.randrange(500)) + rng.choice(["", "/", ".html", "?a=/b", "#x"]))
            rows.append((i, f"http://{host}/{first}/{rest}"))
        rows += [(None, None), (1, "no scheme"), (2, "http://"), (3, "://h.net?x=1"), (3, "://h.net?x=1"), (4, "s://a.net/b\nc//d"), (5, "http://c.org/" + "d/" * 40)]
        rows += [(6, "http://q.org#http://net/"), (7, "HTTP://NET/x"), (8, "http://org/fr/"), (9, "http://a.com:80/" + "y" * 70_000)]
        return rows + [(i, "https://hub.example.org/") for i in range(10_000, 10_200)]

    def test_against_brute_force(self, spark):
        rows = self.rows()
        pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS rule", "3 AS bad", "4 AS template")
        got = url_filters.judged(pages, url_filters.known_label()).select("page_id", "host", "path", "rule", "verdict", "template")
        got, want = Counter(map(tuple, got.collect())), self.want(rows)
        assert got == want
        by_method = Counter(r[4] for r in got.elements() if r[3] is None)
        assert by_method["block"] > 50 and by_method["allow"] > 50

    def test_branches_merge_only_if_alike(self):
        def branch(name, pages, bad=0):
            return {"segment": name, "pages": pages, "end": 0, "{num}": pages, "{hex}": 0, "{slug}": 0, "bad": bad, "good": 0}

        names = url_filters.merged([branch("en", 300), branch("fr", 200), branch("de", 200, bad=200), branch("a|b", 20, bad=19)])
        assert names == {"en": "en|fr", "fr": "en|fr", "de": "a%7Cb|de", "a|b": "a%7Cb|de"}

    def test_empty_table(self, spark):
        empty = spark.createDataFrame([], "page_id long, url string")
        assert url_filters.judged(empty, url_filters.known_label()).count() == 0


class TestManifest:
    FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
    SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"

    def digest(self, text):
        return sha256(text.encode()).hexdigest()

    def leaf(self, row):
        return self.digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def climb(self, nodes):
        """Root, and for each node its siblings by level as (before, after)."""
        paths, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            runs = [range(i, min(i + 3, len(nodes))) for i in range(0, len(nodes), 3)]
            for run in runs:
                for i in run:
                    for leaf in at[i]:
                        paths[leaf].append(("".join(nodes[j] for j in run if j < i), "".join(nodes[j] for j in run if j > i)))
            at = [[leaf for i in run for leaf in at[i]] for run in runs]
            nodes = [self.digest("".join(nodes[i] for i in run)) for run in runs]
        return (nodes or [None])[0], paths

    def want(self, rows):
        sources = defaultdict(list)
        for row in rows:
            sources[row[1]].append(row)
        trees = []
        for source in sorted(sources, key=lambda s: (s is not None, (s or "").encode())):
            ordered = sorted(sources[source], key=lambda r: (r[0] is not None, r[0] or 0, self.leaf(r)))
            trees.append((ordered, *self.climb([self.leaf(r) for r in ordered])))
        root, above = self.climb([t[1] for t in trees])
        out = Counter()
        for (ordered, subroot, paths), over in zip(trees, above, strict=True):
            for row, path in zip(ordered, paths, strict=True):
                seen = list(row)
                if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                    seen[4] = row[4].replace("\n", "")
                node, siblings = self.leaf(seen), ""
                for before, after in path + over:
                    node, siblings = self.digest(before + node + after), siblings + before + after
                out[(row[0], self.leaf(row), subroot, root, self.digest(siblings), node, node == root)] += 1
        return out

    def rows(self, seed, count):
        rng = random.Random(seed)
        sources = ["hub"] * 5 + ["a", "B", "é", "", None, "\U0001f600", "\uffff"]
        rows = [
            (rng.choice([None, rng.randrange(2 * count), -i]), rng.choice(sources), rng.choice(["en", None, ""]), rng.choice([0, None, i]), rng.choice([None, "", "x\ny", f"t{i}\n" * 9, "é\n"]))
            for i in range(count)
        ]
        return rows + rows[:5] * 3 + [(2, "alone", "en", 1, "\n" * 100_000)]

    def query(self, spark, rows, tmp_path):
        frame = spark.createDataFrame(rows, self.SCHEMA).selectExpr("*", "1 AS pos", "2 AS tree", "3 AS node", "4 AS path")
        frame.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
        return manifest.op13(spark, str(tmp_path))

    @pytest.mark.parametrize("levels, count", [(1, 150), (2, 400), (manifest.BLOCK_LEVELS, 300)])
    def test_against_brute_force(self, spark, monkeypatch, tmp_path, levels, count):
        monkeypatch.setattr(manifest, "BLOCK_LEVELS", levels)
        monkeypatch.setattr(manifest, "SPAN", 3**levels)
        monkeypatch.setattr(manifest, "OUT_ROWS", 20)
        rows = self.rows(levels, count)
        got = self.query(spark, rows, tmp_path)
        assert Counter(map(tuple, got.collect())) == self.want(rows)

    def test_one_row_and_none(self, spark, tmp_path):
        row = (7, None, None, None, "a\nb")
        got = self.query(spark, [row], tmp_path / "one").collect()
        assert Counter(map(tuple, got)) == self.want([row])
        assert self.query(spark, [], tmp_path / "none").count() == 0

    @given(st.integers(1, 200))
    @settings(max_examples=60, deadline=None)
    def test_witnesses_of_an_open_block_are_completed_later(self, count):
        leaves = [self.digest(str(i)) for i in range(count)]
        block = manifest.Appender(manifest.height(count))
        for leaf in leaves:
            block.append(leaf)
        root, paths = self.climb(leaves)
        assert block.close() == root
        assert [[tuple(e) for e in w] for w in block.witnesses] == paths
