"""Operators against brute force, and their defined results at the edges."""

from __future__ import annotations

import math
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import DATA, same

from cellwright.llm import registry, similarity_clusters, source_mix
from cellwright.llm.canonical_map import edits, map_to_canonical, tokens_of
from cellwright.llm.container_fill import fill_containers, knapsack, plan
from cellwright.llm.sentence_split import sentences, split, train, units
from cellwright.llm.similar_vectors import hadamard, similar_vectors
from cellwright.llm.similarity_clusters import describe_clusters
from cellwright.llm.source_mix import _fit, entropy, mix_sources, solve, weights
from cellwright.llm.tokens import token_count
from cellwright.operators import descent
from cellwright.operators.descent import neighbour_descent
from cellwright.llm.term_frequency import term_frequencies

INF, NAN = float("inf"), float("nan")


@pytest.fixture(scope="session")
def frame(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert same(registry.QUERIES[name](spark, DATA).toPandas(), duck.sql(registry.ORACLES[name]).df()) is None


# 1 similar vectors


def _brute(points, k):
    out = set()
    for i, p in points.items():
        near = sorted((math.dist(p, q), j) for j, q in points.items() if j != i)[:k]
        out |= {(i, j) for _, j in near}
    return out


def test_hadamard_keeps_lengths():
    v = np.random.default_rng(0).normal(size=(5, 32))
    assert np.allclose(np.linalg.norm(hadamard(v), axis=1), np.linalg.norm(v, axis=1))
    assert np.allclose(hadamard(hadamard(v)), v)


def test_similar_vectors_recall(frame):
    rng = np.random.default_rng(1)
    pts = {i: tuple(map(float, p)) for i, p in enumerate(rng.normal(size=(3000, 2)) * 100)}
    df = frame([("a", i, list(p)) for i, p in pts.items()], "g string, id long, v array<double>")
    got = {(r.id, r.neighbour) for r in similar_vectors(df, "id", "v", ["g"], 2, 5).collect()}
    want = _brute(pts, 5)
    assert len(got & want) / len(want) > 0.98


def test_similar_vectors_in_dense_places(frame):
    rng = np.random.default_rng(5)
    xy = np.vstack([rng.uniform(0, 10_000, (1500, 2)), 5000 + rng.normal(size=(1200, 2)) * 1e-2, 5000 + rng.normal(size=(300, 2)) * 1e-9])
    pts = {i: tuple(map(float, p)) for i, p in enumerate(xy)}
    got = {}
    for r in similar_vectors(frame([("a", i, list(p)) for i, p in pts.items()], "g string, id long, v array<double>"), "id", "v", ["g"], 2, 5, target=25).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    want = _brute(pts, 5)
    assert set(got) == set(pts) and all(len(x) == 5 for x in got.values())
    for part in (range(1500), range(1500, 2700), range(2700, 3000)):  # the sparse and the dense ones alike
        right = [(i, j) for i, j in want if i in part]
        assert np.mean([j in got[i] for i, j in right]) > 0.95


def test_similar_vectors_in_32_dimensions(frame):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(40, 32)).repeat(50, 0) + 0.3 * rng.normal(size=(2000, 32))
    got = {(r.id, r.neighbour) for r in similar_vectors(frame([("a", i, list(map(float, x))) for i, x in enumerate(v)], "g string, id long, v array<double>"), "id", "v", ["g"], 32, 5).collect()}
    want = _brute({i: tuple(x) for i, x in enumerate(v)}, 5)
    assert len(got & want) > 0.9 * len(want)


def test_similar_vectors_edges(frame):
    same_place = [("a", i, [1.0, 1.0]) for i in range(20)]
    rows = [*same_place, ("a", 100, [5.0, 5.0]), ("a", 100, [5.0, 5.0]), ("b", 200, [1.0, 1.0]), ("a", None, [1.0, 1.0]), ("a", 300, None), ("a", 301, [1.0]), ("a", 302, [1.0, NAN]), ("a", 303, [1.0, INF]), ("a", 304, [1.0, None]), (None, 305, [1.0, 1.0])]
    df = frame([(*r, 0) for r in rows], "g string, id long, v array<double>, neighbour int")
    got = defaultdict(set)
    for r in similar_vectors(df, "id", "v", ["g"], 2, 5).collect():
        got[r.id].add((r.neighbour, r.distance))
    assert set(got) == {*range(20), 100}  # 200 is alone in its group
    assert {n for n, _ in got[19]} == {0, 1, 2, 3, 4} and {n for n, _ in got[0]} == {1, 2, 3, 4, 5}
    assert {n for n, _ in got[100]} == {0, 1, 2, 3, 4}
    assert similar_vectors(df.where("false"), "id", "v", ["g"], 2, 5).count() == 0


def test_similar_vectors_cosine(frame):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 24))
    df = frame([("a", i, list(map(float, x))) for i, x in enumerate(v)] + [("a", 999, [0.0] * 24)], "g string, id long, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(300) for j in np.argsort(d[i])[:5]}
    got = {(r.id, r.neighbour) for r in similar_vectors(df, "id", "v", ["g"], 24, 5, metric="cosine").collect()}
    assert len(got) == len(want) and len(got & want) > 0.5 * len(want)  # random directions: nothing is really near
    got = {(r.id, r.neighbour) for r in similar_vectors(df, "id", "v", ["g"], 24, 5, metric="cosine", target=300).collect()}
    assert got == want


# 2 term frequencies


def test_terms_edges(frame):
    rows = [(1, "A", "c1"), (1, "A", "c1"), (2, " a ", "c1"), (3, "A", "c2"), (4, "  ", "c3"), (5, None, "c4"), (None, "A", "c5"), (6, "é", None), (7, "É", "")]
    df = frame(rows, "id long, term string, cell string")
    from pyspark.sql import functions as F

    got = {r.term: (r.occurrences, r.records, r.all_records, r.rare, r.common) for r in term_frequencies(df, "term", "id", ["cell"], F.col("cell") != "", rare_below=3, common_above=0.5).collect()}
    assert got == {"a": (3, 3, 5, False, True), "é": (2, 0, 5, True, False)}
    assert term_frequencies(df.where("false"), "term", "id").count() == 0


# 3 canonical list

REF = [(1, "Sorvacyte", []), (2, "Terminal Sorvacyte", ["TSOR"]), (3, "XKN5+ Sorvacyte", None), (4, "Sorvacyte 3", []), (5, "Type III Rudigen", []), (6, "γδ Rudigen", ["GDR"]), (7, "Rudigen", ["RUDI"]), (8, "Naïve Rudigen", [])]


def test_tokens():
    assert tokens_of("cluster 12: cf. XKN5-hi Sorvacytes (rev) [x]") == ["xkn5+", "sorvacytes"]
    assert tokens_of("γ/δ Rudigen no. III") == ["gd", "rudigen", "3"]
    assert edits("halvoiid", "halvizoid") == 2 and edits("ab", "ba") == 1 and edits("", "abc") == 3


def test_canonical(frame):
    cases = {
        "Sorvacyte": None, "sorvacyte": 1, "SORVACYTES": 1, "Srovacyte": 1, "Sorvac…": 1, "Ter. Sorvacyte": 2, "tsor cells": 2, "XKN5(+) sorvacyte": 3, "XKN6+ Sorvacyte": -1, "c3_Sorvacyte": 1, "Sorvacyte #3": 4,
        "Sorvacyte 4": -1, "Type 3 Rudigen": 5, "Rudigen 3": -1, "gamma-delta Rudigen": 6, "Nai. Rudi.": 8, "Rudi": 7, "artefact": -1, "Sorvacyte, Terminal": 2, "Resident Sorvacyte": -1, "   ": None, " ": None, None: None, "x" * 5000: -1,
    }
    rows = [(i, v, 0) for i, v in enumerate(cases)] * 2
    df = frame(rows, "id long, v string, entry int")
    got = {r.id: r.entry for r in map_to_canonical(df, ["id"], "v", frame(REF, "eid int, name string, aliases array<string>"), "eid", "name", "aliases").collect()}
    assert got == {i: e for i, e in enumerate(cases.values()) if e is not None}
    none = map_to_canonical(df, ["id"], "v", frame([], "eid int, name string, aliases array<string>"), "eid", "name", "aliases").collect()
    assert none and {r.entry for r in none} == {-1}


def test_canonical_rank_decides(frame):
    ref = frame([(10, "Terminal Rudigen"), (11, "Termite Rudigen"), (12, "Termixal Rudigen")], "eid int, name string")
    df = frame([(0, "Termi. Rudigen"), (1, "Terminl Rudigen"), (2, "Termixl Rudigen"), (3, "Terminall Rudigenn")], "id long, v string")
    got = lambda **kw: {r.id: r.entry for r in map_to_canonical(df, ["id"], "v", ref, "eid", "name", **kw).collect()}
    assert got() == {0: 11, 1: 10, 2: 12, 3: 10}  # the longer share, the fewer edits
    assert got(least=0.9) == {0: 11, 1: -1, 2: -1, 3: -1}


# 5 clusters


@pytest.mark.parametrize("dim, n", [(2, 4000), (32, 2000)])
def test_descent_recall(frame, monkeypatch, dim, n):
    monkeypatch.setattr(descent, "BLOCK", n // 4)  # several blocks, so that rounds over the table are needed
    x = np.random.default_rng(dim).normal(size=(n, dim))
    low, high = list(map(float, x.min(0))), list(map(float, x.max(0)))
    places = frame([(1, i, list(map(float, v)), low, high) for i, v in enumerate(x)], "g long, loc long, vec array<double>, low array<double>, high array<double>")
    got = {(r.u, r.v) for r in neighbour_descent(places, dim, 8).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(2) if dim == 2 else (x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(n) for j in np.argsort(d[i])[:8]}
    assert len(got & want) > 0.9 * len(want)


def test_clusters_without_radius_are_communities(frame):
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(6, 16)) * 10, 150, 0) + rng.normal(size=(900, 16))
    members, _ = similarity_clusters.similarity_clusters(frame([("g", i, list(map(float, v))) for i, v in enumerate(x)], "g string, id long, v array<double>"), "id", "v", ["g"], 16)
    of = {r.id: r.cluster for r in members.collect()}
    assert all(len({of[i] for i in range(900) if of[i] == c and i // 150 != c // 150}) == 0 for c in set(of.values())) and len(set(of.values())) < 60


def test_clusters_are_chains_within_radius(frame):
    rng = random.Random(3)
    pts = {i: (rng.uniform(0, 400), rng.uniform(0, 400)) for i in range(500)} | {1000 + i: (600.0 + 19.9 * i, 5.0) for i in range(40)} | {2000: (1.0, 1.0), 2001: (1.0, 1.0)}
    root = {i: i for i in pts}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in pts:
        for j in pts:
            if i < j and math.dist(pts[i], pts[j]) <= 20:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    rows = [("g", i, list(p)) for i, p in pts.items()] + [("g", 1, list(pts[1])), ("g", None, [0.0, 0.0]), ("g", 5000, [NAN, 1.0]), (None, 5001, [1.0, 1.0])]
    members, _ = similarity_clusters.similarity_clusters(frame(rows, "g string, id long, v array<double>"), "id", "v", ["g"], 2, radius=20.0)
    members = members.cache()
    assert {r.id: r.cluster for r in members.collect()} == {i: find(i) for i in pts}
    sizes = Counter(find(i) for i in pts)
    assert {r.cluster: r["size"] for r in describe_clusters(members).collect()} == dict(sizes)


def test_clusters_empty(frame):
    assert similarity_clusters.similarity_clusters(frame([], "g string, id long, v array<double>"), "id", "v", ["g"], 2, radius=20.0)[0].count() == 0


# 6 containers


@pytest.mark.parametrize("n, placed", [(4000, 0.9), (90_000, 0.95)])
def test_plan_solves_the_program(n, placed):
    rng = np.random.default_rng(0)
    sizes, demand = np.unique(np.clip(rng.lognormal(4, 1, n).astype(int) + 1, 1, 512), return_counts=True)
    got = plan(sizes, demand, 512)
    assert (sum(c * k for c, k in got.configurations) == demand).all() and all((c * sizes).sum() <= 512 for c, _ in got.configurations)
    assert got.bound <= sum(k for _, k in got.configurations) <= math.ceil(got.bound * 1.01)
    assert got.by_configuration > placed * (sizes * demand).sum()


def test_plan_bound_beats_volume():
    sizes, demand = np.array([3, 6]), np.array([1, 30])  # two of 6 don't fit into 10: 30 containers, whatever the volume
    got = plan(sizes, demand, 10)
    assert sum(k for _, k in got.configurations) == 30 and 18.3 <= got.bound <= 30
    assert plan(np.array([], int), np.array([], int), 512).configurations == []
    assert plan(np.array([7]), np.array([5]), 7).configurations[0][1] == 5


def test_knapsack_against_brute_force():
    sizes, prices = np.array([3, 4, 9]), np.array([0.31, 0.42, 0.96])
    best = knapsack(prices, sizes, 20)
    for room in range(21):
        assert best[room] == pytest.approx(max(a * 0.31 + b * 0.42 + c * 0.96 for a in range(7) for b in range(6) for c in range(3) if 3 * a + 4 * b + 9 * c <= room))


def test_fill(frame):
    items = [("a", 5), ("b", 25), ("c", 0), ("d", None), (None, 3), ("e", 10), ("f", 7), ("f", 3)] + [(f"x{i}", 4) for i in range(50)]
    got = fill_containers(frame([(*i, 0) for i in items], "id string, n int, container int"), "id", "n", 10).collect()
    used, seen = Counter(), defaultdict(list)
    for r in got:
        seen[r.id].append((r.start, r.length))
        if r.container is not None:
            used[r.container] += r.length
    assert max(used.values()) <= 10 and sum(used.values()) == 5 + 25 + 10 + 7 + 3 + 200
    assert sorted(seen["b"]) == [(0, 10), (10, 10), (20, 5)] and sorted(seen["c"]) == [(0, 0)] and None not in seen
    assert fill_containers(frame([], "id string, n int"), "id", "n", 10).count() == 0


def test_token_counts_agree_with_the_other_library(frame):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    texts = ["The lid is neat. It's 3.50!", "写真 très <|endoftext|>\u0301  \n\n ok", "x" * 45_000, "word " * 9_000 + "  ", "a" + " \n" * 300_000 + "b", "", None]
    got = [r.n for r in frame([(i, x) for i, x in enumerate(texts)], "i int, text string").orderBy("i").select(token_count("text").alias("n")).collect()]
    t.encode_special_tokens = True
    assert got == [len(t.encode(x, add_special_tokens=False).ids) if x else 0 for x in texts]


# 7 mixing


def test_solve():
    shares, tokens, most = {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1000, "b": 100, "c": 400}, {"a": 1, "b": 4, "c": 2}
    w, budget, e = solve(shares, tokens, most)
    assert e == 0 and w == pytest.approx(shares) and budget == pytest.approx(400 / 0.3)
    w, budget, e = solve(shares, tokens, most, budget=1450)
    assert 0 < e < 1 and all(w[s] * budget <= tokens[s] * most[s] * (1 + 1e-9) for s in w) and budget == pytest.approx(1450)
    tight = [w[s] * budget / tokens[s] / most[s] for s in w]
    assert max(tight) == pytest.approx(1) and math.log(w["a"] / w["b"]) == pytest.approx(e * math.log(10) + (1 - e) * math.log(5 / 3))
    w, budget, e = solve(shares, tokens, most, budget=1e6)  # more than any mix of these weights holds
    assert e == 1 and budget == pytest.approx(1500)
    w, _, e = solve(shares, tokens, most, target_entropy=0.9)
    assert entropy(w) == pytest.approx(0.9, abs=1e-6) and math.log(w["a"] / w["b"]) == pytest.approx(e * math.log(10))
    assert weights({"a": 0.9, "b": 0.1}, {"a": 0.5, "b": 0.5}, 0) == pytest.approx({"a": 0.5, "b": 0.5})
    assert solve({"a": 1.0}, {}, {"a": 3})[:2] == ({}, 0.0)


def test_last_part_of_a_budget():
    assert _fit(10, [4, 50, 3, 9, 2]) == [True, False, True, False, True]
    assert _fit(10, [9, 11]) == [True, False] and _fit(10, [11, 30]) == [True, False] and _fit(0.4, [1]) == [False]


def test_budget_ends_inside_blocks(frame, monkeypatch):
    monkeypatch.setattr(source_mix, "BLOCK", 16)  # the end is narrowed several times, also among copies of one id
    docs = [(i, "web", 10) for i in range(3000)] + [(-1, "web", 10)] * 3000 + [(10_000 + i, "mail", 7) for i in range(900)]
    targets = frame([("web", 0.5, 1), ("mail", 0.5, 2)], "source string, target_share double, max_repeats int")
    rows, report = mix_sources(frame(docs, "id long, source string, size int"), "id", "source", "size", targets)
    got = {r.source: r.mixed_tokens for r in report.collect()}
    assert got["mail"] == 2 * 900 * 7 and abs(got["web"] - 2 * 900 * 7) <= 5
    assert rows.count() == len(docs) and rows.where("source = 'web'").agg({"uses": "max"}).first()[0] == 1


def test_mix(frame):
    rng = random.Random(0)
    docs = [(i, rng.choice([" Web", "web", "WEB", "web", "web"]), rng.randint(1, 50)) for i in range(4000)] + [(10_000 + i, "Mail-Survey", rng.randint(1, 50)) for i in range(300)] + [(20_000, "other", 9), (20_001, None, 9), (20_002, "web", None)]
    targets = frame([("web", 0.6, 1), ("mail_survey", 0.4, 3), ("none", 0.0, None)], "source string, target_share double, max_repeats int")
    rows, report = mix_sources(frame([(*d, 0) for d in docs], "id long, source string, size int, uses int"), "id", "source", "size", targets)
    rows, report = rows.collect(), {r.source: r for r in report.collect()}
    assert len(rows) == len(docs) and all(r.uses <= {"web": 1, "mail_survey": 3}.get(r.source, 0) for r in rows)
    assert report["web"].reached_share == pytest.approx(0.6, abs=0.005) and report["mail_survey"].reached_share == pytest.approx(0.4, abs=0.005)
    assert report[None].mixed_tokens == 0
    empty = mix_sources(frame([], "id long, source string, size int"), "id", "source", "size", targets)[1].collect()
    assert {r.mixed_tokens for r in empty} == {0}


# 8 sentences


@pytest.fixture(scope="session")
def model(spark):
    docs = spark.read.parquet(f"{DATA.rpartition('/')[0]}/sf0.01/documents.parquet")
    return train(docs, "doc_id", "text")


@pytest.mark.parametrize(
    "text, want",
    [
        ("The U.K. plug was in the box. The lid is neat!", ["The U.K. plug was in the box.", "The lid is neat!"]),
        ('He told me "Send it back. We will check." but nothing happened. Fine.', ['He told me "Send it back. We will check." but nothing happened.', "Fine."]),
        ("It is solid. 😀 I paid $3.50 for it...", ["It is solid. 😀", "I paid $3.50 for it..."]),
        ("- One line\n- Another line.", ["- One line", "- Another line."]),
        ("写真よりきれいです。3日に注文しました！", ["写真よりきれいです。", "3日に注文しました！"]),
        ("फ़ोटो से भी सुंदर है। साइज़ 5 ठीक है।", ["फ़ोटो से भी सुंदर है।", "साइज़ 5 ठीक है।"]),
        ("Le fermoir est léger. M. Untel du dépôt a appelé.", ["Le fermoir est léger.", "M. Untel du dépôt a appelé."]),
        ("Mido 1,70 m. El cable es ligero.", ["Mido 1,70 m.", "El cable es ligero."]),
        ("The lid is neat.<br/>The base is not.", ["The lid is neat.", "The base is not."]),
        ("", []),
        (" \n\t ", []),
    ],
)
def test_sentences(model, text, want):
    assert [text[a:b] for a, b in split(text, *model)] == want


def test_units_wrapped():
    text = "This is a text that somebody wrapped at some forty\ncolumns because their mail program did so and they\nnever looked at it again."
    assert len(list(units(text))) == 1 and len(list(units("One\n\nTwo<br>Three"))) == 3


def test_sentences_cover_and_stay_in_order(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "title")
    got = defaultdict(list)
    for r in sentences(docs, "doc_id", "text").collect():
        got[r.id].append((r.sent_start, r.sent_end))
    for d in docs.collect():
        spans = sorted(got.get(d.doc_id, []))
        assert bool(spans) == bool(d.text and d.text.strip())
        for (a, b), nxt in zip(spans, [*spans[1:], (10**9, 0)]):
            assert a < b <= nxt[0] and d.text[a:b] == d.text[a:b].strip()


def test_sentences_edges(frame):
    long = "The lid is neat. " * 3000
    df = frame([(1, None, 0), (2, "", 0), (3, " ", 0), (4, long, 0), (5, unicodedata.normalize("NFD", "Très bien. Où est-il ?"), 0), (5, unicodedata.normalize("NFD", "Très bien. Où est-il ?"), 0)], "doc long, text string, id int")
    n = Counter(r.id for r in sentences(df, "doc", "text").collect())
    assert set(n) == {4, 5} and n[4] >= 1
    assert sentences(df.where("false"), "doc", "text").count() == 0
