import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import exact_dedup, ngram_join, substring_dedup, vector_links
from tidemark.llm.components import components, star_components
from tidemark.llm.work import Work

DOC = "doc_id long, text string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def texts(n, seed, vocabulary=400, least=20, most=80):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{k}" for k in rng.integers(0, vocabulary, rng.integers(least, most))) for _ in range(n)]


def test_directory_doubles_only_where_it_must():
    d = exact_dedup.build_directory({0: 5, 1: 5, 8: 1}, 4, 5)
    assert len(d) == 16 and d[0] != d[1] and len(set(d[8:])) == 1
    assert list(exact_dedup.build_directory({}, 4, 5)) == [0] and len(set(exact_dedup.build_directory({}, 4, 5, 2))) == 4
    assert len(exact_dedup.build_directory({3: 100}, 4, 5)) == 16  # a bucket of one prefix stays overfull


@pytest.mark.parametrize("key_bits", [64, 3])
def test_exact_groups(frame, key_bits):
    rows = [(1, "Ab c"), (2, "aB C"), (3, "É"), (4, "é"), (5, None), (6, ""), (None, "x"), (7, "X"), (8, "one"), (8, "one"), (9, "z" * 300_000), (10, "Z" * 300_000)]
    rows += [(100 + i, t) for i, t in enumerate(texts(40, 1))]
    got = exact_dedup.exact_groups(frame(rows, DOC), capacity=4, key_bits=key_bits).collect()
    norm = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    expected = Counter()
    for i, t in rows:
        own = groups[norm(t)]
        expected[i, max((x for x in own if x is not None), default=None), len(own), hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_hot_group_is_joined_by_broadcast(frame):
    got = exact_dedup.exact_groups(frame([(i, "same") for i in range(500)] + [(1000, "other")], DOC)).collect()
    assert Counter((r.keep_id, r.group_size) for r in got) == {(499, 500): 500, (1000, 1): 1}


def test_empty_tables(frame):
    none = frame([], DOC)
    assert exact_dedup.exact_groups(none).count() == 0
    assert ngram_join.similar_documents(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert vector_links.link_vectors(frame([], "vec_id long, embedding array<float>, label int")).rows.count() == 0


def test_stages_keep_columns_and_settle_ties(frame):
    schema = "doc_id long, text string, sha string, node string, kept string"
    rows = [(1, "a b c d e f", "s", "n", "k"), (1, "a b c d e f", "s2", "n", "k"), (2, "A b c d e f", "s", "n", "k"), (3, None, None, None, None), (None, "q", "s", "n", "k")]
    out = exact_dedup.drop_exact_copies(frame(rows, schema))
    assert out.columns == ["doc_id", "text", "sha", "node", "kept"] and sorted(str(r.doc_id) for r in out.collect()) == ["2", "3", "None"]
    out = ngram_join.drop_near_copies(frame(rows, schema))
    assert out.columns == ["doc_id", "text", "sha", "node", "kept"] and sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "None"]


def test_clashing_columns_pass(frame):
    schema = "doc_id long, text string, __own long, __Doc_Id long, own_set string, KEPT_ID long, kept_node long, hot int, __node long"
    rows = [(1, "a b c d e f", 7, 8, "o", 9, 10, 1, 2), (1, "a b c d e f", 7, 8, "o", 9, 10, 1, 2), (2, "A b c d e f", 17, 18, "p", 19, 20, 2, 3)]
    for drop, kept in ((ngram_join.drop_near_copies, 1), (exact_dedup.drop_exact_copies, 2)):
        out = drop(frame(rows, schema))
        assert out.columns == frame([], schema).columns and [tuple(r) for r in out.collect()] == [x for x in dict.fromkeys(rows) if x[0] == kept]


def near_rows():
    base = texts(25, 3, 3000)
    rng = np.random.default_rng(4)
    rows = []
    for t in base:
        rows.append(t)
        for _ in range(int(rng.integers(0, 4))):
            w = t.split()
            for k in rng.integers(0, len(w), int(rng.integers(0, 3))):
                w[k] = f"n{rng.integers(1000)}"
            rows.append(" ".join(w))
    return list(enumerate([*rows, base[0], base[0].upper(), "too short", "too short", "", None, "   "]))


def test_similar_documents_match_brute_force(frame):
    rows = near_rows()
    sets = {}
    for i, t in rows:
        w = WORDS.findall((t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    links = {i: {j for j in sets if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in sets}
    expected = {}
    for i in sets:
        seen, front = {i}, [i]
        while front:
            front = [j for k in front for j in links[k] - seen]
            seen.update(front)
        expected[i] = (min(seen), len(links[i]), i == min(seen))
    got = {r.doc_id: (r.class_id, r.n_links, r.kept) for r in ngram_join.similar_documents(frame(rows, DOC)).collect()}
    assert got == expected and any(n for _, n, _ in expected.values())


def test_blocks_give_what_one_block_gives(frame, monkeypatch):
    rows = near_rows() + [(1000 + i, "a b c d e f g h i j k l m n o p q r s t u v " + f"x{i}") for i in range(30)]
    whole = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.similar_documents(frame(rows, DOC)).collect())
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "PROFILE", 12)
    monkeypatch.setattr(ngram_join, "PREFIX_NODES", 9)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.similar_documents(frame(rows, DOC)).collect()) == whole


def template_pages(n, seed=5):
    """Pages of one template at a similarity of some 0.6: candidates, but none links with another."""
    rng = np.random.default_rng(seed)
    frame = [f"t{k}" for k in range(120)]
    return [(i, " ".join(frame + [f"p{x}" for x in rng.integers(0, 1 << 40, 40)])) for i in range(n)]


def test_template_pages_part(spark, frame):
    work = Work(spark, "template")
    rows = template_pages(600) + [(1000 + i, " ".join(f"c{k}" for k in range(60)) + f" v{i}") for i in range(150)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.similar_documents(frame(rows, DOC), work=work).collect()}
    assert all(got[i] == (i, 0) for i in range(600)) and all(got[1000 + i] == (1000, 149) for i in range(150))
    before, after = (spark.read.parquet(f"{work.path}/{x}") for x in ("candidates-stars", "placed"))
    assert before.count() > 500 and after.count() == 150 and after.agg({"m": "max"}).first()[0] == 150


def test_repeated_and_null_ids_fetch_their_own_sets(frame):
    rows = [(None if k % 2 else 5, f"a b c d e f g h i j k l m n o p q r s t u v w x y z {k}") for k in range(40)] + [(None, f"other {k} words here now {k}") for k in range(20)]
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.similar_documents(frame(rows, DOC)).collect())
    assert got == {(None, 5, 39): 20, (5, 5, 39): 20, (None, None, 0): 20}


@pytest.mark.parametrize("n", [1, 4, 5, 10, 37])
def test_prefixes_of_linked_sets_meet(n):
    rng = np.random.default_rng(n)
    for _ in range(50):
        a = set(range(n))
        b = set(rng.permutation(n)[: n - int(rng.integers(0, n))].tolist()) | set(range(n, n + int(rng.integers(0, 4))))
        if len(a & b) >= 0.8 * len(a | b):
            order = {x: k for k, x in enumerate(rng.permutation(n + 4).tolist())}
            first = [set(sorted(x, key=order.get)[: ngram_join.prefix_size(len(x), 0.8)]) for x in (a, b)]
            assert first[0] & first[1]


def test_bands_reach_the_recall():
    bands, rows = ngram_join.bands_for(0.8, 0.9995, 128)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9995
    assert ngram_join.bands_for(1.0, 0.9, 8) == (1, 8)


def test_repeated_rows_are_copies(frame):
    got = ngram_join.similar_documents(frame([(1, "a b c d e f")] * 3, DOC)).collect()
    assert [(r.class_id, r.n_links) for r in got] == [(1, 2)] * 3 and sum(r.kept for r in got) == 1


def plain_removal(rows, size):
    words = [WORDS.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[k : k + size]) for w in words for k in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {j for k in range(len(w) - size + 1) if count[tuple(w[k : k + size])] > 1 for j in range(k, k + size)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out)


def test_removal_matches_brute_force(frame):
    base = texts(30, 7, 500, 10, 60)
    passage = " ".join(f"p{k}" for k in range(50))
    rows = [(i, t) for i, t in enumerate(base)] + [(50 + i, f"{t}\t{passage}\n{u}") for i, (t, u) in enumerate(zip(base[:9], base[20:29], strict=True))]
    rows += [(90, "r " * 100), (91, passage + " " + passage), (92, None), (93, ""), (None, base[0]), (94, "é " * 40 + "\xa0x"), (95, base[3]), (95, base[3]), (96, "long " * 3 + "w" * 1_200_000)]
    for size in (35, 8):
        got = substring_dedup.remove_repeats(frame(rows, DOC), size).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got) == plain_removal(rows, size)


def test_long_texts_are_hashed_in_segments():
    from tidemark.llm import words

    t = " ".join(f"a{k}" for k in range(250_000)).encode()
    one = words.Corpus([t, b"a5 a6"])
    assert one.words[5] == one.words[one.first[1]] and len(one.words) == 250_002 and len(np.unique(one.words)) == 250_000


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    out = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), Work(spark, "test"), "c").collect()}
    assert out == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (380, 2))]
    least = {x: x for e in edges for x in e}
    while any(least[a] != least[b] for a, b in edges):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    out = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), Work(spark, "test"), "c").collect()}
    assert out == {x: least[x] for e in edges if e[0] != e[1] for x in e}
    stars = [e for a, b in edges for e in ((a, min(a, b)), (b, min(a, b)), (min(a, b), min(a, b)))]
    out = {r.node: r.label for r in star_components(spark.createDataFrame(stars, "node long, root long"), Work(spark, "test"), "s").collect()}
    assert out == least
    assert components(spark.createDataFrame([(7, 7)], "a long, b long"), Work(spark, "test"), "c").count() == 0


def vectors():
    rng = np.random.default_rng(9)
    rows, k = [], 0
    for _ in range(60):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 8))):
            rows.append((k, [float(x) for x in centre + 0.08 * rng.normal(size=16)], int(rng.integers(0, 2))))
            k += 1
    same = rows[0][1]
    rows += [(k + i, same, rows[0][2]) for i in range(5)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, same, None), (903, [float("nan")] * 16, 1), (904, [1.0, None], 1), (905, [], 1), (906, same[:8], rows[0][2]), (907, [2 * x for x in same], rows[0][2])]
    return rows


@pytest.mark.parametrize("shard", [1500, 20])
def test_links_match_brute_force(frame, monkeypatch, shard):
    monkeypatch.setattr(vector_links, "SHARD", shard)
    rows = vectors()
    ok = {i: np.array(v, float) for i, v, label in rows if v and label is not None and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: x for i, _, x in rows}
    links = {i: {j for j in ok if j != i and label[i] == label[j] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.sqrt((ok[i] @ ok[i]) * (ok[j] @ ok[j])) >= 0.98} for i in ok}
    out = vector_links.link_vectors(frame(rows, "vec_id long, embedding array<double>, label int"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out.rows.collect()}
    total = sum(map(len, links.values()))
    assert len(got) == len(rows) and all(got[i] == (0, i, True) for i in (900, 901, 902, 903, 904, 905, 906))
    assert all(got[i][0] <= len(links[i]) for i in links) and sum(got[i][0] for i in links) >= 0.97 * total > 0
    if shard == 1500:
        assert {i: got[i][0] for i in links} == {i: len(v) for i, v in links.items()}
    assert out.recall >= 0.9


def linked(rows, threshold=0.98):
    """n_links and component of each row by brute force; rows: vec_id, vector, label."""
    ids, x, label = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    x = x / np.abs(x).max(1, keepdims=True)
    near = (x @ x.T / np.sqrt(np.outer((x * x).sum(1), (x * x).sum(1))) >= threshold) & (label[:, None] == label) & ~np.eye(len(x), dtype=bool)
    least = ids.copy()
    while True:
        now = np.minimum(least, np.where(near, least, ids.max()).min(1))
        if (now == least).all():
            return {int(i): (int(n), int(c)) for i, n, c in zip(ids, near.sum(1), least, strict=True)}
        least = now


def pairs_with_a_hot_label():
    rng = np.random.default_rng(3)
    rows = []
    for k in range(400):
        centre, label = rng.normal(size=16), 0 if k % 3 else int(rng.integers(1, 10))
        rows += [(2 * k + i, [float(v) for v in centre + 0.02 * i * rng.normal(size=16)], label) for i in range(2)]
    dense = rng.normal(size=16)
    return rows + [(1000 + i, [float(v) for v in dense + 0.05 * rng.normal(size=16)], 0) for i in range(150)]


@pytest.mark.parametrize(("shard", "most"), [(1500, 4096), (1500, 40), (60, 40), (20, 9)])
def test_oversize_shards_lose_no_links(frame, monkeypatch, shard, most):
    monkeypatch.setattr(vector_links, "SHARD", shard)
    monkeypatch.setattr(vector_links, "MOST_SHARD", most)
    rows = pairs_with_a_hot_label()
    out = vector_links.link_vectors(frame(rows, "vec_id long, embedding array<double>, label int"))
    assert {r.vec_id: (r.n_links, r.component_id) for r in out.rows.collect()} == linked(rows)


def test_a_result_that_lost_links_is_an_error(frame, monkeypatch):
    rows = pairs_with_a_hot_label()
    compare, search = vector_links._compare, vector_links._search
    monkeypatch.setattr(vector_links, "_search", lambda threshold, beam: search(threshold + 0.018, beam))
    out = vector_links.link_vectors(frame(rows, "vec_id long, embedding array<double>, label int"))
    assert len(out.recalls) == 3 and out.recalls[0] < 0.9 and {r.vec_id: (r.n_links, r.component_id) for r in out.rows.collect()} == linked(rows)
    monkeypatch.setattr(vector_links, "_compare", lambda threshold: compare(threshold + 0.018))
    with pytest.raises(RuntimeError, match="differ from brute force"):
        vector_links.link_vectors(frame(rows, "vec_id long, embedding array<double>, label int"))


@pytest.mark.parametrize("n", [2, 3, 41, 700])
def test_graph_search_finds_what_is_in_range(n):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(max(1, n // 20), 24))
    x = vector_links._unit(np.repeat(centres, 20, 0)[:n] + 0.05 * rng.normal(size=(min(n, 20 * len(centres)), 24)))
    a, b = vector_links.build_edges(x, vector_links.DEGREE)
    assert np.bincount(a).max() <= 3 * vector_links.DEGREE and (a != b).all()
    lists = vector_links._lists(np.arange(len(x)), pa.chunked_array([pa.array([sorted({int(t) for t in b[a == i]}) for i in range(len(x))], pa.list_(pa.int64()))]))
    found = vector_links.range_search(x, lists, vector_links.medoids(x, 8), np.arange(len(x)), 0.975, vector_links.BEAM)
    true = x @ x.T >= 0.975
    assert not (found & ~true).any() and found.sum() >= 0.995 * true.sum()


def clumps(versions=4, edits=100, seed=8):
    """Tight clumps of more vectors than a bounded neighbour list holds; versions are linked to one another, edits at about 0.999."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=32)
    rows = []
    for v in range(versions):
        version = base + 0.085 * rng.normal(size=32)
        rows += [(edits * v + i, [float(x) for x in version + 0.01 * rng.normal(size=32)], 0) for i in range(edits)]
    return rows


def test_tight_clumps_stay_one_component(frame):
    rows = clumps()
    out = vector_links.link_vectors(frame(rows, "vec_id long, embedding array<double>, label int"))
    expected = linked(rows)
    assert {c for _, c in expected.values()} == {0} and min(n for n, _ in expected.values()) > 100
    assert {r.vec_id: (r.n_links, r.component_id) for r in out.rows.collect()} == expected and out.recalls == [1.0]


def test_links_count_at_both_ends():
    rows = [(0, 5, 2, [1.0, 0.0]), (2, 6, 3, [1.0, 0.1]), (2, 7, 4, [0.0, 1.0])]
    table = pa.table({"role": pa.array([r[0] for r in rows], pa.int32()), "node": [r[1] for r in rows], "weight": [r[2] for r in rows], "vector": [np.array(r[3]).tobytes() for r in rows]})
    out = vector_links._compare(0.98)(table).to_pylist()
    assert {(r["node"], r["root"], r["links"]) for r in out} == {(5, 5, 3), (6, 5, 2)}


def test_very_large_and_small_vectors_link(frame):
    rows = [(1, [1.0, 2.0], 0), (2, [1e200, 2e200], 0), (3, [1e-200, 2e-200], 0), (4, [1.7e308, -1.7e308], 0), (5, [5e-324, -5e-324], 0), (6, [0.0, 0.0], 0)]
    out = vector_links.link_vectors(frame(rows, "vec_id long, embedding array<double>, label int")).rows.collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6)}


@pytest.mark.parametrize("key_bits", [64, 3])
def test_an_index_is_opened_and_looked_up_again(spark, key_bits):
    from tidemark.llm.exact_dedup import exact_groups, find_copies

    texts = [f"Text {k % 40}" for k in range(200)] + [None, "", "TEXT 1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    work = Work(spark, "index-test")
    groups = {r.text_sha256: (r.keep_id, r.group_size) for r in exact_groups(docs, capacity=4, key_bits=key_bits, work=work).collect()}
    asked = ["text 7", "TEXT 7", "unknown", None, "text 1"] + ["teXt 3"] * 300
    got = sorted(tuple(r) for r in find_copies(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), work.path).collect())
    want = [groups.get(hashlib.sha256((x or "").lower().encode()).hexdigest(), (None, None)) for x in asked]
    assert got == [(k, *w) for k, w in enumerate(want)] and want[2] == (None, None) and want[4] == (202, 6)
    assert find_copies(docs.limit(0), work.path).collect() == []
