import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import html_text, mixing, packing, quality, token_store, tokens, toxicity

DOC = "doc_id long, text string"
SF = "/root/testdata/sf0.01"
public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")

ODD = ["", "a", " a", "  a", "a  b", "a \n b", "\n a", " ", "a ", "a\n", "it's a 's", "a\t b", "<|endoftext|> a", "a <|endoftext|>b", "...  --- 12 3a", "a\xa0 b", "　a b\n\n c", "a .b c,, d'' e'll f\"'", "a \nb c\n\nd e.\nf.\ng \n \nh i\n", "ª º ſ Ǆ ×÷ µ x`^ \x1c a", "re.\nSh x|y of%%% é,\nÀ"]


def test_cached_ids_are_the_tokenizers(spark):
    own = tokens.Encoder(PATH)
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(120).collect()]
    for text in ODD + ODD + docs + docs[:20]:
        assert np.frombuffer(own.ids([text])[0], "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    assert own.ids([None]) == [b""]


@pytest.mark.parametrize("order", [1, -1])
def test_cached_ids_dont_depend_on_what_came_before(order):
    own = tokens.Encoder(PATH)
    rng = np.random.default_rng(6)
    alphabet = ["a", "b", "Bar", "y", " ", " ", "\n", "\n", ".", ",", "é", "1", "\t", "'s", "ß", "\r\n", "-", "ſ"]
    made = ["".join(rng.choice(alphabet, int(rng.integers(1, 9)))) for _ in range(20_000)]
    for text in ["One x.\nBar y", "One x \nBar y"][::order] + made + made[:3000]:
        assert np.frombuffer(own.ids([text])[0], "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_met_within_a_generation_are_not_encoded_again(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_LATE", 3)
    own, runs = tokens.Encoder(PATH), []
    encode = own.tokenize
    own.tokenize = lambda run: runs.append(run) or encode(run)
    whole = own.tokenizer.encode
    text = "Qaab qaac qaad qaae qaaf qaac qaae qaad"
    assert np.frombuffer(own.ids([text])[0], "<u4").tolist() == whole(text, add_special_tokens=False).ids
    assert sorted(runs) == sorted(["Qaab", *(f"Ġqaa{c}" for c in "cdef")])
    monkeypatch.setattr(tokens, "CACHE_WORDS", 0)  # nothing is kept for good: what is met again moves to the next generation
    for text in ODD + ["Qaag qaah, qaag\nQaah qaai. qaah, qaaj qaak. qaah, ñaé. Ñaé ñaé"] * 3:
        assert np.frombuffer(own.ids([text])[0], "<u4").tolist() == whole(text, add_special_tokens=False).ids, repr(text)
    assert len(own.late) <= 3 and len(own.older) <= 4


def plain_ids(rows):
    own = tokens.Encoder(PATH).tokenizer
    return [np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t in rows]


ROWS = [(5, "one two three"), (1, None), (2, ""), (3, "long " * 5000), (None, "x y"), (4, "same"), (4, "same"), (7, "long " * 5000 + "end"), *((20 + i, t) for i, t in enumerate(ODD))]


def test_store_round_trip(frame):
    store = token_store.write_store(frame(ROWS, DOC), PATH)
    ids = plain_ids(ROWS)
    order = sorted(range(len(ROWS)), key=lambda k: (ROWS[k][0] is not None, ROWS[k][0] or 0))
    start, expected = 0, Counter()
    for k in order:
        expected[ROWS[k][0], start, len(ids[k]), zlib.crc32(ids[k].tobytes())] += 1
        start += len(ids[k])
    assert Counter((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in store.documents().collect()) == expected
    back = {r.doc_id: r.ids for r in store.ids(frame([(3,), (20,)], "doc_id long")).collect()}
    assert back == {3: ids[3].tolist(), 20: ids[8].tolist()}
    assert store.verify() and store.chunks.count() == store.chunks.select("digest").distinct().count()


def test_changed_chunks_are_found(frame):
    store = token_store.write_store(frame([(1, "a b c")], DOC), PATH)
    broken = token_store.TokenStore(store.chunks.withColumn("payload", F.lit(b"xx")), store.recipes, store.manifest, store.wide, store.work)
    with pytest.raises(Exception, match="digest"):
        broken.documents().collect()
    assert not token_store.TokenStore(store.chunks, store.recipes.withColumn("n_tokens", F.lit(9).cast("long")), store.manifest, store.wide, store.work).verify()


def test_missing_recipes_are_an_error(frame):
    store = token_store.write_store(frame([(k, f"text {k}") for k in range(40)], DOC), PATH)
    short = token_store.TokenStore(store.chunks, store.recipes.filter("doc_id <> 7"), store.manifest, store.wide, store.work)
    gone = token_store.TokenStore(store.chunks, store.recipes.filter(F.shiftright("recipe", 33) > 0), store.manifest, store.wide, store.work)
    for lost in (short, gone):
        with pytest.raises(ValueError, match="manifest"):
            lost.documents().collect()
    assert store.documents().count() == 40


def test_cuts_depend_on_content_alone():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50_000, 20_000).astype("<u4")
    cuts = token_store.cut_points(ids)
    moved = token_store.cut_points(np.concatenate([rng.integers(0, 50_000, 777).astype("<u4"), ids]))
    assert cuts[-1] == 20_000 and len(set(cuts) & {c - 777 for c in moved}) > 0.8 * len(cuts) > 10
    assert max(np.diff([0, *cuts])) <= token_store.MOST and token_store.cut_points(ids[:5]) == [5]


def test_shifted_crcs_add_up():
    a, b, c = b"x" * 1000, b"yz" * 37, b"q"
    out = token_store.shift_crc(np.array([zlib.crc32(a), zlib.crc32(b), zlib.crc32(c)]), np.array([len(b) + 1, 1, 0]))
    assert np.bitwise_xor.reduce(out) == zlib.crc32(a + b + c)


@pytest.mark.parametrize("task_bins", [250_000, 3])
def test_packing_is_whole_and_gapless(frame, task_bins):
    rows = ROWS + [(100 + i, "w " * int(n)) for i, n in enumerate(np.random.default_rng(2).integers(1, 900, 60))]
    ids = plain_ids(rows)
    out = packing.pack_documents(frame(rows, DOC).repartition(5), PATH, task_bins=task_bins).toPandas().sort_values(["sequence_id", "offset"])
    assert out.groupby("sequence_id").length.sum().max() <= 1024
    assert (out.groupby("sequence_id").length.cumsum() - out.length == out.offset).all()
    expected = Counter()
    for (i, _), own in zip(rows, ids, strict=True):
        start = 0
        for k, n in enumerate(packing.cut_lengths(len(own), 1024)):
            expected[str(i), k, start, n, zlib.crc32(own[start : start + n].tobytes())] += 1
            start += n
    name = lambda x: "None" if np.isnan(x) else str(int(x))
    assert Counter((name(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out.astype({"doc_id": float}).itertuples()) == expected
    if task_bins > 3:
        assert out.sequence_id.nunique() <= -(-sum(map(len, ids)) // 1024) + 2


def test_bins_are_packed_as_in_one_task(frame):
    """Sequences by brute force: best fit, the longest first, over all pieces at once; the rounds need few more."""
    sizes = np.random.default_rng(4).integers(1, 700, 400)
    out = packing.pack_documents(frame([(i, "w " * int(n)) for i, n in enumerate(sizes)], DOC).repartition(40), PATH, fan_in=3)
    lengths = np.array([r.length for r in out.collect()])
    assert out.select("sequence_id").distinct().count() <= 1.03 * len(packing.best_fit(lengths, 1024)[2])


def test_a_common_chunk_is_looked_up_by_broadcast(frame):
    rows = [(i, "same text") for i in range(600)] + [(1000, "other")]
    out = token_store.write_store(frame(rows, DOC), PATH).documents().collect()
    ids = plain_ids(rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == Counter((i, len(x), zlib.crc32(x.tobytes())) for (i, _), x in zip(rows, ids, strict=True))


def test_a_replaced_recipe_is_an_error(frame):
    store = token_store.write_store(frame([(1, "a b c"), (2, "d e f g")], DOC), PATH)
    one, two = store.recipes.filter("doc_id = 1"), store.recipes.filter("doc_id = 2").first()
    swapped = one.select("doc_id", "recipe", F.lit(two.n_tokens).alias("n_tokens"), F.lit(bytes(two.refs)).alias("refs"), F.lit(bytes(two.root)).alias("root"))
    broken = token_store.TokenStore(store.chunks, swapped.unionByName(store.recipes.filter("doc_id = 2")), store.manifest, store.wide, store.work)
    with pytest.raises(ValueError, match="manifest"):
        broken.documents().collect()


def test_best_fit():
    bins, offsets, fills = packing.best_fit(np.array([6, 4, 5, 5, 3]), 10)
    assert fills.tolist() == [10, 10, 3] and bins.tolist() == [0, 0, 1, 1, 2] and offsets.tolist() == [0, 6, 0, 5, 0]
    assert packing.cut_lengths(2500, 1024) == [452, 1024, 1024] and packing.cut_lengths(1024, 1024) == [1024]


def test_packing_nothing(frame):
    assert packing.pack_documents(frame([], DOC), PATH).count() == 0
    assert token_store.write_store(frame([], DOC), PATH).documents().count() == 0


def held_out(spark, scored, column, folds, held):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = scored.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) for r in rows)
    own = [r for r in rows if r.held_out]
    return np.array([r.predicted for r in own]), np.array([r[column] for r in own])


def test_quality_on_held_out_rows(spark):
    scored = quality.quality_scores(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    predicted, label = held_out(spark, scored, "quality", 5, 0)
    assert (predicted == label).mean() > 0.97 and scored.count() == 1000


def test_toxicity_on_held_out_rows(spark):
    scored = toxicity.toxicity_scores(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    predicted, label = held_out(spark, scored, "toxic", 3, 1)
    assert (predicted == label).mean() > 0.94 and predicted[label == 0].mean() < 0.02 and scored.count() == 1000


def voted(rng, label, n):
    """Votes of six voters: 1 to 3 mostly repeat voter 0, 4 votes on other toxic rows than they do, 5 at random."""
    votes = np.zeros((n, 6))
    kind = rng.random(n)
    first = np.where(label == 1, kind < 0.5, rng.random(n) < 0.06)
    votes[:, :4] = first[:, None] & (rng.random((n, 4)) < 0.97)
    votes[:, 4] = np.where(label == 1, kind >= 0.5, rng.random(n) < 0.04)
    votes[:, 5] = rng.random(n) < 0.2
    return votes


def fitted_labels(votes, label):
    model = toxicity.LabelModel(votes.shape[1], 0.2)
    model.unlabelled = 0.1
    for step in range(6):
        model.update(model.sums(votes, label, np.ones(len(votes))), pair=step in (0, 3))
    return model


def test_label_model_counts_repeating_voters_once():
    rng = np.random.default_rng(4)
    true = (rng.random(6000) < 0.2).astype(int)
    votes = voted(rng, true, 6000)
    given = np.where(rng.random(6000) < 0.01, 1 - true, true).astype(float)
    label = np.where(np.arange(6000) < 4000, given, np.nan)
    model = fitted_labels(votes, label)
    clean, toxic = ({frozenset(p) for p in own.tolist()} for own in model.pairs)
    assert sum(p <= {0, 1, 2, 3} for p in clean) == 3  # repeating voters
    assert set().union(*toxic) == {0, 1, 2, 3, 4}  # and one that votes where they don't
    # Brute force: the share of toxic rows among all rows with the same votes.
    patterns, of, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share = np.bincount(of.ravel(), true) / count
    many = count >= 100
    assert np.abs(model.posterior(patterns, np.full(len(patterns), np.nan)) - share)[many].max() < 0.1


@pytest.mark.parametrize("operator", [quality.quality_scores, toxicity.toxicity_scores])
def test_scores_of_odd_rows(frame, operator):
    rows = [(1, None), (2, ""), (None, "x"), (3, "a b"), (3, "a b"), (4, "word " * 200_000), (5, "\n\n"), (6, "!!! ??? ###")]
    labels = [(1, 1, 0), (2, 0, 1), (3, None, None), (3, 1, 0), (4, 0, 1), (5, 1, 0), (6, 1, 1), (None, 1, 1)]
    for own in (labels, []):
        out = operator(frame(rows, DOC), frame(own, "doc_id long, quality int, toxic int")).collect()
        assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in out) and all(not r.held_out for r in out if r.doc_id is None)
    assert operator(frame([], DOC), frame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_isotonic():
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert y.tolist() == [0.0, 0.5, 1.0] and x.tolist() == [1.0, 2.5, 4.0]


def test_stems_leave_out_what_a_shorter_one_covers():
    rows = [("abcd", 30, 0), ("abcde", 25, 0), ("abcdx$", 20, 0), ("zz$", 15, 0), ("the$", 40, 400)]
    assert toxicity.choose_stems(rows, 100, 1000, 10) == ["abcd", "zz$"]


def mixed(docs, evenness, repeats, budget, seed=17):
    """The plain version: the exponent by scanning the grid's neighbourhood, blocks by sorting."""
    import hashlib

    md5 = lambda *p: int(hashlib.md5(":".join(p).encode()).hexdigest()[:15], 16)
    rows = [(i, s, len((t or "").encode().split()), md5(str(seed), "" if i is None else str(i), hashlib.md5((t or "").encode()).hexdigest())) for i, t, s in docs]
    total = Counter()
    for _, s, n, _ in rows:
        total[s] += n
    total = {s: n for s, n in total.items() if n}
    everything = sum(total.values())
    budget = everything if budget is None else budget
    q = np.array([n / everything for n in total.values()])
    t = np.array(list(total.values()))

    def at(k):
        p = q ** (k / (1 << 20))
        w = p / p.sum()
        return -(w * np.log(w)).sum(), (w * budget / t).max(), w

    lo, hi = 0, (1 << 20) + 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if at(mid)[0] >= evenness * np.log(len(q)) - 1e-12 else (lo, mid)
    low, high = -1, 1 << 20
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if at(mid)[1] <= repeats + 1e-12 else (mid, high)
    weights = dict(zip(total, at(max(lo, high))[2], strict=True))
    out = Counter()
    for s in total:
        own = int(np.floor(weights[s] * budget + 1e-6))
        epochs, left = divmod(own, total[s])
        blocks = defaultdict(list)
        for r in rows:
            if r[1] == s:
                blocks[r[3] >> 50].append(r)
        order = sorted(blocks, key=lambda b: (md5(str(seed), str(epochs), s or "", str(b)), b))
        taken = set()
        for b in order:
            size = sum(r[2] for r in blocks[b])
            if left >= size:
                taken.update(r[3] for r in blocks[b])
            elif left > 0:
                used = 0
                for u in sorted({r[3] for r in blocks[b]}):
                    used += sum(r[2] for r in blocks[b] if r[3] == u)
                    if used <= left:
                        taken.add(u)
            left -= size
        for r in rows:
            if r[1] == s and (n := epochs + (r[3] in taken)):
                out[r[0]] += n
    return out


@pytest.mark.parametrize(("evenness", "repeats", "budget"), [(0.95, 4.0, None), (1.0, 1.5, None), (0.0, 4.0, None), (0.99, 100.0, 60_000), (0.9, 4.0, 3_000)])
def test_mix_matches_the_plain_version(frame, evenness, repeats, budget):
    rng = np.random.default_rng(5)
    docs = [(k, " ".join(["w"] * int(rng.integers(0, 60))), "abcd"[min(3, int(rng.exponential(0.8)))]) for k in range(700)]
    docs += [(9000, None, "a"), (9001, "x y", None), (9002, "", "empty"), (None, "x", "a"), (9003, "q " * 9, "b"), (9003, "q " * 9, "b")]
    df = frame(docs, "doc_id long, text string, source string")
    options = dict(evenness=evenness, max_repeats=repeats, budget=budget)
    out = mixing.mixed_order(df, **options).collect()
    assert Counter(r.doc_id for r in out) == mixed(docs, evenness, repeats, budget)
    clash = df.withColumn("block", F.lit(1)).withColumn("copies", F.lit("x")).withColumn("epoch", F.lit(None).cast("int"))
    mixed_docs = mixing.mix_documents(clash, **options)
    assert mixed_docs.columns == clash.columns and Counter(r.doc_id for r in mixed_docs.collect()) == Counter(r.doc_id for r in out)
    assert "Python" not in mixed_docs._jdf.queryExecution().executedPlan().toString()


def test_mix_of_nothing(frame):
    assert mixing.mix_documents(frame([], "doc_id long, text string, source string")).count() == 0


HTML = [
    ("<p>One <b>two</b>\n three<p>Four<br>five<div hidden>no</div>", "One two three\n\nFour\nfive"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>", "- a\n- b\n  3. x\n  4. y"),
    ("<table><tr><th>Name<th>N<tr><td>Long name<td>1<tr><td colspan=2>wide</table>", "Name       N\nLong name  1\nwide"),
    ("<style>.x, #y{display:none}</style><i class='a x'>no</i><b id=y>no</b><span style='visibility:hidden'>no</span>yes", "yes"),
    ("<pre> a\n  b</pre>c", " a\n  b\n\nc"),
    ("<head><title>t</title></head>a &lt; b &amp; c<script>d</script><!-- e -->", "a < b & c"),
    ("<details><summary>s</summary>no</details><dialog>no</dialog><template>no</template>", "s"),
    ("a<b", "a<b"), ("", ""), ("<", "<"), ("<p>a<!-- x", "a"), ("</p></div>x", "x"), ("<div>" * 30_000 + "x", "x"), ("<a title='>'>x</a>", "x"), ("x" * 100_000, "x" * 100_000),
]


@pytest.mark.parametrize(("source", "text"), HTML, ids=range(len(HTML)))
def test_html(source, text):
    assert html_text.html_to_text(source) == text


SHOWN = [
    ("<style>@media print{.a{display:none}} @media (max-width:600px){#b{display:none}} @media screen{.c{display:none}}</style><p class=a>a<p id=b>b<p class=c>c", "a\n\nb"),
    ("<style media=print>p{display:none}</style><p>a", "a"),
    ("<style>.tab{display:none} .tab.active{display:block}</style><div class='tab active'>a</div><div class=tab>b</div>", "a"),
    ("<style>.tab{display:none} #x .tab:first-child{display:block}</style><div id=x><p class=tab>a<p class=tab>b</div>", "a"),
    ("<style>.t{display:none} input:checked ~ .t{display:block}</style><div><p class=t>a</p><input type=radio checked><p class=t>b</p></div>", "b"),
    ("<style>p{display:none !important} .x{display:block}</style><p class=x style='display:block'>a</p>b", "b"),
    ("<style>.x{display:none}</style><p class=x style='display:block'>a</p><p class=x>b", "a"),
    ("<style>.x{display:none; &.on{display:block}} p:hover{display:none}</style><p class='x on'>a<p class=x>b<p>c", "a\n\nc"),
    ("<style>/* p{display:none} */ p{backface-visibility:hidden}</style><p>a<p style='backface-visibility:hidden'>b", "a\n\nb"),
    ("<style>.off p:unheard-of(1){display:none} .g,.off>b{display:none}</style><div class=off><p>a</p><b>no</b><i class=g>no</i></div>", "a"),
    ("<div style='visibility:hidden'>no <b style='visibility:visible'>a</b><img alt=no></div><p hidden style='display:block'>b<p hidden>no", "a\n\nb"),
    ("x <math><mi>a</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>no</annotation></math> y", "x a= 1 2 y"),
    ("<svg><title>no</title><defs><text>no</text></defs><rect/><g><text x=1>Jan</text><text x=9>Feb</text></g>no</svg>z", "Jan Feb z"),
    ("<svg><foreignObject><p>a</p></foreignObject><path/></svg><map name=m><area alt=no>b</map><svg><g><p>c", "a\n\nb\n\nc"),
]


@pytest.mark.parametrize(("source", "text"), SHOWN, ids=range(len(SHOWN)))
def test_html_shows_what_a_browser_shows(source, text):
    assert html_text.html_to_text(source) == text


def test_html_rows_spanned_from_above():
    assert html_text.html_to_text("<table><tr><td rowspan=2>A<td>b<tr><td>c<td>d<tr><td>e<td>f</table>") == "A  b\n   c  d\ne  f"
    assert html_text.html_to_text("<table><tr><td>a<td rowspan=3 colspan=2>w<td>b<tr><td>c<td>d</table>") == "a  w   b\nc      d"


LONG = {
    "tags that never end": "<a " * 300_000, "names": "<" + "a" * 1_000_000, "open elements": "<i>" * 150_000 + "</p>" * 150_000, "ends in a cell": "<b><table><td>" + "<i>" * 100_000 + "</b>x" * 100_000,
    "quotes": "<a '\">\"'" * 100_000, "last quote": "<a ='>x" * 100_001, "lists": "<ul><li>x" * 50_000, "tables": "<table><td>x" * 50_000, "less": "< " * 300_000 + ">", "comments": "<!-" * 300_000, "quoted blocks": "<blockquote>y" * 50_000,
}


@pytest.mark.parametrize("kind", LONG)
def test_html_takes_linear_time(kind):
    import time

    source = LONG[kind]
    began = time.process_time()
    text = html_text.html_to_text(source)
    assert time.process_time() - began < 20 and len(text) < 30 * len(source)


def test_html_after_a_quote_that_never_ends():
    assert html_text.html_to_text("<p>a<a href='x>b</a><p>c <b>d</b>") == "ab\n\nc d"


def test_html_table(frame):
    rows = [(1, "<p>a", "u"), (1, "<p>a", "u"), (2, None, None), (None, "b", "u")]
    out = html_text.extract_text(frame(rows, "page_id long, html string, text string")).collect()
    assert sorted((str(r.page_id), str(r.text)) for r in out) == [("1", "a"), ("1", "a"), ("2", "None"), ("None", "b")]
    assert html_text.extract_text(frame([], "page_id long, html string")).count() == 0


def test_all_shown_words_come_out(spark):
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.words, self.off = [], 0

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("script", "style", "title")

        def handle_endtag(self, tag):
            self.off -= tag in ("script", "style", "title")

        def handle_data(self, data):
            if not self.off:
                self.words += data.split()

    for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").limit(60).collect():
        plain = Plain()
        plain.feed(r.html)
        got = Counter(w for w in html_text.html_to_text(r.html).split() if w != "-")
        if "display:none" not in r.html and "hidden" not in r.html:
            assert Counter(w for w in plain.words if w != "-") == got
