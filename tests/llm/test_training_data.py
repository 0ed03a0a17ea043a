"""The operators against plain versions on a small table that holds the odd cases, and on their own."""

import itertools
import math
import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftgauge.llm import (
    class_lm, decontaminate, disclosure, mixing, quality_crf, queries, repeats, selection, simhash, token_counts,
    token_files, tokens, topk,
)

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, size string, key int, row string"
RNG = random.Random(3)
VOCABULARY = [("".join(RNG.choice("abcdefghijé") for _ in range(RNG.randint(1, 9)))) for _ in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def odd_documents():
    passage, page = prose(40), prose(120)
    item = prose(20)
    texts = [
        None, "", " \n\t ", "one", "Two words", page, page, page.replace(" ", "\n", 3), page + " more",
        prose(60) + " " + passage + " " + prose(30), prose(10) + "\n" + passage, passage, "a" * 400, "a" * 700 + "b" * 60,
        "mail me@example.com or me@example.com_x@y.z, 10.0.0.256 10.0.0.255 +1 (456) 555-2186 4111 1111 1111 1111",
        "Ünïcode ΣΑΣ — “quoted” text with odd　spaces \x1c and\x0bcontrol <|endoftext|> don't it's we'LL",
        item, "before " + item.translate({c: c - 32 for c in range(97, 123)}) + " after", prose(3000), "x " * 3000, "\n\n\n", "tab\tand\rreturn", "...!!! ,,, 12345 678",
        "4" * 300 + " " + "1.2.3.4" * 50, "+" * 200 + "9" * 30, "@" * 50 + "a@b" * 40, "\U0001F600 emoji ́combining é",
    ]
    rows = [(i, t, "en", f"s{i % 4}", 0, "size", i, "row") for i, t in enumerate(texts)]
    rows[3] = (3, "one", None, None, None, None, None, None)
    rows += [(5, page, "en", "s1", 0, "x", 1, "y"), (None, "text without an id", "en", "s0", 0, "x", 1, "y"), (None, None, None, None, None, None, None, None)]
    return rows, [(7, item), (8, "one"), (9, None), (10, "..."), (7, prose(15)), (11, "Two words")]


_ROWS = odd_documents()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows, items = _ROWS
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, i % 2, 0) for i in range(20)] + [(3, None, 0), (None, 1, 0), (2, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=8).round(2).tolist()) for i in range(140)] + [(50, None), (151, [1.0, None] * 4), (152, [math.nan] * 8)]
    vectors += [(i, [0.25] * 8) for i in range(200, 230)] + [(250, [0.25] * 8), (300, [0.0] * 8), (None, [1.0] * 8), (260, [1.0] * 3), (350, [2.0] * 3)]
    vectors += [(201, [0.25] * 8), (400, [math.inf] + [1.0] * 7)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for name, schema in (
        ("documents", DOCUMENTS), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int"),
        ("embeddings", "vec_id long, embedding array<float>"),
    ):
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}.parquet")
    return path


def odd_documents_rows():
    return _ROWS[0]


def documents():
    return [(r[0], r[1]) for r in _ROWS[0]]


def same(got, expected):
    key = lambda r: tuple((x is None, 0 if x is None else x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, expected), key=key)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_tables_give_empty_results(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


def test_pipeline_of_empty_tables(spark, empty):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).collect() == []


def test_quality_scores_every_row(spark, folder):
    got = queries.op1_quality_crf(spark, folder).collect()
    assert len(got) == len(documents())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    same([(r.doc_id, r.held_out) for r in got], [(d, brute.fold(d, 3) == 1) for d, _ in documents()])


def test_forward_backward_is_enumeration():
    rng = np.random.default_rng(0)
    lengths, t = np.asarray([3, 1, 4]), rng.normal(size=(2, 2))
    s = rng.normal(size=8)
    good, pairs, z = quality_crf.marginals(s, lengths, t)
    at, expected, expected_pairs = 0, [], np.zeros((2, 2))
    for d, n in enumerate(lengths):
        weights = {}
        for y in itertools.product((0, 1), repeat=int(n)):
            weights[y] = math.exp(sum(s[at + i] * y[i] for i in range(n)) + sum(t[a, b] for a, b in zip(y, y[1:])))
        total = sum(weights.values())
        assert z[d] == pytest.approx(math.log(total))
        expected += [sum(w for y, w in weights.items() if y[i]) / total for i in range(n)]
        for y, w in weights.items():
            for a, b in zip(y, y[1:]):
                expected_pairs[a, b] += w / total
        at += n
    np.testing.assert_allclose(good, expected)
    np.testing.assert_allclose(pairs, expected_pairs)


def test_line_model_learns_from_lines():
    rng = random.Random(1)
    good = [("\n".join(prose(12, rng) for _ in range(5))).encode() for _ in range(60)]
    bad = [("\n".join(prose(12, rng).upper() + "!!" for _ in range(5))).encode() for _ in range(60)]
    s, _, n = quality_crf.line_statistics(good[:40] + bad[:40])
    model = quality_crf.fit(s, n, np.asarray([1] * 40 + [0] * 40), rounds=60)
    assert (quality_crf.score_texts(good[40:], model)[0] > 0.5).all()
    assert (quality_crf.score_texts(bad[40:], model)[0] < 0.5).all()


@pytest.mark.parametrize("hot", [64, 1])
def test_near_duplicates(spark, folder, hot):
    rows = [(d, brute.fingerprint(t)) for d, t in documents()]
    component = brute.components(rows)
    got = simhash.near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"), hot=hot).collect()
    same(got, [(d, f"{f:016x}", component[f]) for d, f in rows])


@pytest.mark.parametrize("hot", [64, 1])
def test_links_of_close_fingerprints(spark, hot):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for b in base for _ in range(40)})
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    frame = spark.createDataFrame([(s, s) for s in signed], "node long, fp long")
    from driftgauge.llm.components import connected_components

    found = {r.node: r.component for r in connected_components(simhash.links(frame, hot)).collect()}
    expected = brute.components(list(enumerate(prints)))
    groups = {}
    for s, f in zip(signed, prints):
        groups.setdefault(expected[f], set()).add(found.get(s, s))
    assert all(len(g) == 1 for g in groups.values())
    assert len({min(g) for g in groups.values()}) == len(groups)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def settled_plans(patch, *modules):
    """The plans of all tables that ``modules`` write, by name, as they come."""
    from driftgauge.session import settle

    plans = []
    for module in modules:
        patch.setattr(module, "settle", lambda df, name: plans.append((name, plan_of(df))) or settle(df, name))
    return plans


def test_opened_groups_are_not_broadcast(spark, monkeypatch):
    from driftgauge.llm import components

    plans = settled_plans(monkeypatch, components)
    frame = spark.createDataFrame([(i, i) for i in range(8)], "node long, fp long")
    stars = simhash._stars(frame)
    assert "SortMergeJoin" in plan_of(stars) and "Broadcast" not in plan_of(stars)
    found = components.connected_components(stars.distinct()).collect()
    assert {(r.node, r.component) for r in found} == {(i, 0) for i in range(8)}
    assert plans and all("Broadcast" not in plan for _, plan in plans)


def test_variants_are_not_broadcast(spark, folder, monkeypatch):
    plans = settled_plans(monkeypatch, simhash)
    got = simhash.near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))
    assert len(got.collect()) == len(documents())
    plans.append(("result", plan_of(got)))
    assert {"shared-variants", "fingerprint-links", "result"} <= {name for name, _ in plans}
    assert [name for name, plan in plans if "Broadcast" in plan] == []


@pytest.fixture(scope="module")
def byte_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))


@pytest.mark.parametrize("chunk,overlap", [(32_768, 256), (64, 8), (700, 16)])
def test_token_counts(spark, folder, byte_bpe, chunk, overlap):
    got = token_counts.count_tokens(
        spark.read.parquet(f"{folder}/documents.parquet"), queries.vocabulary("byte_bpe_50k.json"), chunk, overlap
    ).collect()
    count = lambda t: len(byte_bpe.encode(t or "", add_special_tokens=False).ids)
    same(got, [(d, len((t or "").encode()), count(t)) for d, t in documents()])


def test_chunks_reach_over_stable_places():
    text = prose(500) + "z" * 900 + " " + prose(200)
    places = token_counts.cut(text, 300, 10)
    assert len(places) > 3 and places[0][0] == 0 and places[-1][1] == len(text)
    assert all(a < b and c <= b for (a, b), (c, _) in zip(places, places[1:]))
    assert token_counts.cut("z" * 5000, 300, 10) == [(0, 5000)]


def test_spliced_chunks_that_differ_are_refused():
    one = {"places": [5, 9], "before": [2, 4], "marks": [1, 2], "total": 5, "start": 0, "end": 12}
    two = {"places": [5, 9], "before": [1, 3], "marks": [7, 2], "total": 9, "start": 3, "end": 40}
    assert token_counts.splice([one, two]) == 2 + 9 - 1
    assert token_counts.splice([one, {**two, "marks": [7, 3]}]) is None
    assert token_counts.splice([one, {**two, "places": [50, 60]}]) is None


def test_pieces_have_the_tokens_of_the_whole(byte_bpe):
    memory = tokens.PieceMemory(queries.vocabulary("byte_bpe_50k.json"), len, sum, lead="\u0120", limit=20, longest=10)
    for text in (t for _, t in documents() if t):
        data = text.encode()
        if tokens.ODD_SPACE.search(data):
            continue
        got = sum(tokens.values_of(memory, [tokens.SPACED_WORD.findall(data)])[0])
        assert got == len(byte_bpe.encode(text, add_special_tokens=False).ids)


def test_personal_data(spark, folder):
    got = queries.op4_disclosure(spark, folder).collect()
    expected = []
    for d, t in documents():
        spans = brute.base_spans(t)
        expected.append((d, *(sum(k == i for _, i, _, _ in spans) for k in range(4)), ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)))
    same([(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) for r in got], expected)


def test_terms_that_disclose(spark):
    rng = random.Random(5)
    rows = [(i, f"{prose(5, rng)} Zorblax wrote from zed@mail.org today {prose(6, rng)}") for i in range(3)]
    rows += [(10 + i, f"{prose(8, rng)} today {prose(9, rng)}") for i in range(30)] + [(50, "ask Zorblax, please. " + prose(4, rng))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in disclosure.sanitise(docs, generalise=0.8, with_text=True).collect()}
    assert all("[EMAIL]" in got[i].text and "zed@" not in got[i].text for i in range(3))
    assert [s.value for s in got[50].spans] == ["Zorblax"] and "Zorblax" not in got[50].text
    assert not got[10].spans and got[10].text == dict(rows)[10]


def test_terms_near_entities_are_whole_words(spark):
    """A disclosing term that ends common words: their ends at a cut or beside an entity are no terms."""
    reach = disclosure.REACH
    rows = [(i, f"{prose(4)} ttee wrote{i} from zed@mail.org {prose(3)}") for i in range(3)]
    pad = "x" * (reach - 6)
    rows += [(10 + i, f"committee {pad} u{i}@mail.org") for i in range(20)] + [(40 + i, f"host u{i}@mail.org {pad} tteeing") for i in range(20)]
    rows += [(70 + i, f"ttee10.0.0.{i}") for i in range(20)] + [(100 + i, prose(9)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = disclosure.base_spans(docs).collect()
    for r in spans:
        for c in r.contexts:
            if r.doc_id >= 10:
                assert not {"ttee", "committee", "tteeing"} & set((c.left + " " + c.right).split())
    found = {r.term: r.disclosure for r in disclosure.disclosing_terms(docs, disclosure.base_spans(docs)).collect()}
    assert found["ttee"] == pytest.approx(1)


@pytest.mark.parametrize(
    "written,term", [("(Zorblax)", "Zorblax"), ('"Meier"', "Meier"), ("O'Neil", "O'Neil"), ("Smith-Jones", "Smith-Jones"), ("EMP1042", "EMP1042"), ("\u738b\u660e", "\u738b\u660e")]
)
def test_terms_of_any_form_disclose(spark, written, term):
    rng = random.Random(5)
    rows = [(i, f"{prose(5, rng)} {written} wrote from zed@mail.org today {prose(6, rng)}") for i in range(3)]
    rows += [(10 + i, f"{prose(8, rng)} wrote from today {prose(9, rng)}") for i in range(30)] + [(50, f"ask {written}; today, x{term} {term}-x")]
    got = {r.doc_id: r for r in disclosure.sanitise(spark.createDataFrame(rows, "doc_id long, text string"), generalise=0.8, with_text=True).collect()}
    assert [s.value for s in got[50].spans] == [term] and got[50].text.endswith(f"; today, x{term} {term}-x")
    assert all(term not in got[i].text and "[EMAIL]" in got[i].text for i in range(3))


@pytest.mark.parametrize("few,rows", [(1 << 20, 1 << 20), (0, 50)])
def test_repeated_windows(spark, folder, few, rows):
    got = repeats.remove_repeats(
        spark.read.parquet(f"{folder}/documents.parquet"), broadcast_rows=few, run_rows=rows, piece=2000
    ).collect()
    same(got, [(d, *r) for (d, _), r in zip(documents(), brute.repeats(documents()))])


def test_every_window_has_an_anchor_chosen_by_its_bytes():
    rng = random.Random(4)
    text = "".join(rng.choice("ab ") for _ in range(3000)).encode()
    whole = repeats.anchors(repeats.Bytes([text]))
    for s in range(0, 2900, 37):
        inner = repeats.anchors(repeats.Bytes([text[s : s + 50]])) + s
        assert len(inner) and set(inner) <= set(whole)


def test_class_scores(spark, folder):
    got = queries.op6_class_bigrams(spark, folder).collect()
    expected = brute.unigram_scores(documents())
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got],
         [(d, *e[:4], round(e[4], 6)) for (d, _), e in zip(documents(), expected)])
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_rare_words_are_joined_and_words_of_a_class_add_up(spark):
    rng = random.Random(6)
    rows = [(i, prose(80, rng)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = quality_crf.fold(of=7) == 2
    expected = {d: e for (d, _), e in zip(rows, brute.unigram_scores(rows))}
    for r in class_lm.score_documents(docs, held, head=50, exchanged=20, classes=4, rounds=2).collect():
        assert r.base_score == pytest.approx(expected[r.doc_id][4]) and r.n_known == expected[r.doc_id][2]
    words = class_lm.count_words(docs, ~held)
    voc = class_lm.vocabulary(words, 34, 50)
    assert 0 < len(voc.counts) <= 50
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.encode("text", "utf-8").alias("text"), held.alias("held_out")).mapInArrow(
        class_lm._number_words(voc), class_lm.NUMBERED
    )
    model = class_lm.cluster(numbered, voc, 4, 20, 2)
    np.testing.assert_allclose((10**model.transition).sum(1), 1)
    head = 10 ** model.emission[: len(voc.counts)]
    for c in range(4):
        assert head[model.class_of[: len(voc.counts)] == c].sum() == pytest.approx(1) or c not in model.class_of[:20]
    seen = {w.encode() for w, _ in ((r.word, r.n) for r in words.collect())}
    clustered = set(voc.blob.split(b"\n")[: 20])
    n = {r.word.encode(): r.n for r in words.collect()}
    for shape in range(class_lm.SHAPES):
        members = [w for w in seen - clustered if min(len(w) // 4, class_lm.SHAPES - 1) == shape]
        total = sum(n[w] + class_lm.EMISSION for w in members) + class_lm.EMISSION
        assert total / 10 ** model.shape_base[shape] == pytest.approx(1)


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(2)
    k, classes, n = 4 + class_lm.SHAPES + 1, 4, 40
    truth = np.arange(n) % 2
    words = np.zeros((n, n), np.int64)
    for a in range(n):
        for b in range(n):
            words[a, b] = rng.poisson(20 if truth[a] != truth[b] else 1)
    of = rng.integers(0, classes, n)

    def counts():
        onto = np.eye(k, dtype=np.int64)[of]
        return words.T @ onto, words @ onto, onto.T @ words @ onto

    def likelihood():
        p = counts()[2].astype(float)
        return class_lm._xlogx(p).sum() - 2 * class_lm._xlogx(p.sum(1)).sum()

    first = likelihood()
    for turn in range(6):
        before, after, pairs = counts()
        moving = np.flatnonzero(np.arange(n) % 2 == turn % 2)
        of = of.copy()
        of[moving] = class_lm.better_classes(before[moving], after[moving], pairs, of[moving], classes)
    assert likelihood() > first
    assert len({tuple(sorted(set(of[truth == t]))) for t in (0, 1)}) == 2


@pytest.mark.parametrize("head", [10, 1000])
def test_words_beyond_the_exchanged_ones_are_clustered(spark, head):
    """Words of equal length differ in their neighbours alone; before, all but the exchanged ones were one class."""
    rng = random.Random(5)
    a, b = [f"a{i:03}" for i in range(60)], [f"b{i:03}" for i in range(60)]
    some = lambda words: rng.choice(words[:4] if rng.random() < 0.5 else words)
    texts = [" ".join(f"xxxx xxxx {some(a)} yyyy {some(b)}" for _ in range(5)) for _ in range(100)]
    right = " ".join(f"xxxx xxxx {v} yyyy {w}" for v, w in zip(a, b))
    wrong = " ".join(f"xxxx xxxx {w} yyyy {v}" for v, w in zip(a, b))
    rows = list(enumerate([*texts, right, wrong, "xxxx never yyyy seen"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = class_lm.score_documents(docs, F.col("doc_id") >= 100, head=head, exchanged=10, classes=4, rounds=4)
    score = {r.doc_id: r.score for r in got.collect()}
    assert score[100] > score[101] + 50 and math.isfinite(score[102])
    other = class_lm.score_documents(docs, F.col("doc_id") >= 100, head=60, exchanged=10, classes=4, rounds=4)
    assert score == pytest.approx({r.doc_id: r.score for r in other.collect()})


def test_the_class_a_word_joins_is_the_likeliest():
    rng = np.random.default_rng(7)
    classes, k, words = 4, 4 + class_lm.SHAPES + 1, 30
    text = rng.integers(0, words, 3000)
    text = text[np.append(True, text[1:] != text[:-1])]
    of = np.where(np.arange(words) < 12, np.arange(words) % classes, classes + np.arange(words) % 3)

    def likelihood(of):
        p = np.zeros((k, k), np.int64)
        np.add.at(p, (of[text[:-1]], of[text[1:]]), 1)
        return class_lm._xlogx(p).sum() - 2 * class_lm._xlogx(p.sum(1)).sum()

    pairs, counts = np.zeros((k, k), np.int64), np.zeros((words, 2 * k), np.int64)
    np.add.at(pairs, (of[text[:-1]], of[text[1:]]), 1)
    np.add.at(counts, (text[1:], of[text[:-1]]), 1)
    np.add.at(counts, (text[:-1], k + of[text[1:]]), 1)
    word, column = np.nonzero(counts[12:])
    found = class_lm.best_classes(word, column, counts[12:][word, column], of[12:], pairs, classes)
    for w, c in zip(range(12, words), found):
        each = [likelihood(np.where(np.arange(words) == w, c, of)) for c in range(classes)]
        assert each[c] > max(each) - 0.5  # the text's ends
    assert len(set(found.tolist())) > 1


@pytest.mark.parametrize("block", [1 << 18, 100])
def test_token_files(spark, folder, tmp_path, block):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    out = str(tmp_path / "files")
    token_files.write_tokens(spark.read.parquet(f"{folder}/documents.parquet"), out, path, block_ids=block)
    got = sorted(token_files.read_tokens(spark, out).collect(), key=lambda r: r.start)
    ids = [library.encode(t or "", add_special_tokens=False).ids + [1] for _, t in documents()]
    same([(r.doc_id, r.n_tokens, bytes(r.ids)) for r in got], [(d, len(i), np.asarray(i, "<u4").tobytes()) for (d, _), i in zip(documents(), ids)])
    order = [(r.doc_id is None, r.doc_id or 0) for r in got]
    assert order == sorted(order)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in got)


def test_packing_is_undone():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype("<u4")
        control, data = token_files.pack(ranks)
        assert (token_files.unpack(control, data, n) == ranks).all()
        assert len(control) == -(-n // 4)


@pytest.mark.parametrize("bucket,queries_in", [(2048, 256), (16, 3)])
def test_search(spark, folder, bucket, queries_in):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    got = topk.top_k(table, "vec_id % 50 = 0", bucket=bucket, query_block=queries_in).collect()
    same([(r.query_id, r["rank"], r.vec_id, r.score) for r in got], brute.top_k([tuple(r) for r in table.collect()]))


def test_pruned_candidates_are_none_of_the_best():
    rng = np.random.default_rng(3)
    v = rng.integers(-90, 90, (400, 16))
    v[::3] //= 8
    norms = np.sqrt((v**2).sum(1).astype(float))
    order = np.argsort(-norms)
    v, norms, ids = v[order], norms[order], np.arange(400)
    q = v[::10]
    floors = np.sort(q @ v[:30].T, axis=1)[:, -5].astype(float)
    got = topk.search_block(np.arange(40) * 10, norms[::10], q, floors, ids, norms, v, 5)
    for i in range(40):
        scores = q[i] @ v.T
        scores[i * 10] = -(1 << 40)
        expected = [int(j) for j in np.lexsort((ids, -scores))[:5] if scores[j] >= floors[i]]
        assert [b for a, b, _ in got if a == i * 10][: len(expected)] == expected


@pytest.mark.parametrize("bucket_rows", [4000, 2])
def test_mixing(spark, folder, bucket_rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = mixing.mix(docs, bucket_rows=bucket_rows).collect()
    sizes = {}
    for r in odd_documents_rows():
        sizes[r[3]] = sizes.get(r[3], 0) + len(brute.words(r[1]))
    expected = brute.targets(sizes)
    taken = {s: sum(r.taken for r in got if r.source == s) for s in sizes}
    same([(r.doc_id, r.source, r.size) for r in got], [(r[0], r[3], len(brute.words(r[1]))) for r in odd_documents_rows()])
    assert all(r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source]) for r in got)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    assert all(abs(taken[s] - expected[s]) <= 1 for s in sizes)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(docs, bucket_rows=3).collect()))


def test_small_keys_prefer_good_documents(spark):
    rows = [(i, "word " * 10, "s", i % 2) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, good int")
    got = mixing.mix(docs, share=0.5, quality=F.when(F.col("good") == 1, 1.0).otherwise(0.25)).collect()
    good = sum(r.taken for r in got if r.doc_id % 2)
    assert good / sum(r.taken for r in got) > 0.65


@pytest.mark.parametrize("shard,block", [(4 << 20, 8 << 20), (300, 30)])
def test_decontamination(spark, folder, shard, block):
    items = _ROWS[1]
    report = decontaminate.benchmark_matches(
        spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"), shard_bytes=shard, block_bytes=block
    )
    got = decontaminate.contaminated(report).collect()
    expected = []
    for d, t in documents():
        r = brute.contamination(t, items)
        expected.append((d, *r, r[1] > 0 and 20 * r[1] >= r[0]))
    same([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got], expected)
    places = {r.doc_id: r.places for r in got if r.doc_id is not None}
    assert any(p.item_id == "7" and p.start == 1 and p.words == 13 for p in places[17])


def test_pipeline_stages(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "near-duplicates", "benchmark decontamination", "mixing to target weights", "token files"]
    rows = odd_documents_rows()
    good = stages["quality classifier"](spark, docs, folder)
    model = queries.fitted_quality(spark, docs, folder)
    score = [quality_crf.score_texts([(r[1] or "").encode()], model)[0][0] for r in rows]
    same([(r.doc_id, r.text) for r in good.collect()], [(r[0], r[1]) for r, s in zip(rows, score) if s >= 0.5])
    one = stages["near-duplicates"](spark, docs, folder)
    component = brute.components([(d, brute.fingerprint(t)) for d, t in documents()])
    expected = {(d, t) for d, t in documents() if d is None or component[brute.fingerprint(t)] == d}
    same([(r.doc_id, r.text) for r in one.collect()], expected)
    clean = stages["benchmark decontamination"](spark, docs, folder)
    hit = {d for d, t in documents() if (r := brute.contamination(t, _ROWS[1])) and r[1] and 20 * r[1] >= r[0]}
    same([(r.doc_id, r.text) for r in clean.collect()], [(d, t) for d, t in documents() if d not in hit])
    mix = stages["mixing to target weights"](spark, docs, folder)
    assert [f.name for f in mix.schema] == [f.name for f in good.schema] == [f.name for f in one.schema] == docs.columns
    taken = {}
    for r in mixing.mix(docs).collect():
        t = taken.setdefault(r.doc_id, [0, 0])
        t[0] += r.taken
        t[1] += r.size
    copies = {d: -(-t // s) for d, (t, s) in taken.items() if t}
    same([(r.doc_id,) for r in mix.collect()], [(d,) for d, _ in documents() for _ in range(copies.get(d, 0))])
    assert {c for c, _ in stages["token files"](spark, docs, folder).dtypes} == {"doc_id", "start", "n_tokens", "ids_crc32"}
    whole = corpus_pipeline.run(spark, folder).collect()
    assert whole and {r.doc_id for r in whole} <= {d for d, _ in documents()} - hit


def test_rows_without_documents_stay_whole(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, "c")], "doc_id long, text string")
    kept = selection.without(docs, spark.createDataFrame([(2,), (2,), (None,)], "doc_id long")).collect()
    same(kept, [(1, "a"), (1, "a"), (None, "b")])


def test_batches_are_cut_by_bytes():
    from driftgauge.llm.common import in_pieces

    batch = pa.RecordBatch.from_arrays([pa.array([b"x" * n for n in (5, 5, 50, 1)], pa.binary())], names=["text"])
    assert [b.num_rows for b in in_pieces([batch], "text", 12)] == [2, 1, 1]


@pytest.mark.parametrize("run_rows", [1 << 20, 30])
def test_repeats_of_stitched_passages(spark, run_rows):
    """Runs that touch and overlap: what is removed from one document is still a source for later ones."""
    rng = random.Random(8)
    passages = ["".join(rng.choice("abcde ") for _ in range(rng.randint(20, 90))) for _ in range(14)]
    rows = []
    for i in range(70):
        parts = [rng.choice(passages) if rng.random() < 0.8 else "".join(rng.choice("xyz") for _ in range(rng.randint(1, 60))) for _ in range(6)]
        rows.append((i, "".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = repeats.remove_repeats(docs, run_rows=run_rows, piece=3000).collect()
    same(got, [(d, *r) for (d, _), r in zip(rows, brute.repeats(rows))])


def test_scores_don_t_depend_on_the_batch():
    texts = [(t or "").encode() for _, t in documents()]
    s, _, n = quality_crf.line_statistics(texts)
    model = quality_crf.fit(s, n, np.asarray([i % 2 for i in range(len(texts))]), rounds=20)
    together = quality_crf.score_texts(texts, model)[0]
    np.testing.assert_allclose(together, [quality_crf.score_texts([t], model)[0][0] for t in texts])


@pytest.mark.parametrize("far", [0, 1 << 62])
@pytest.mark.parametrize("run_rows,broadcast_rows", [(1 << 20, 1 << 20), (60, 0)])
def test_rows_of_one_id_lose_what_they_repeat_themselves(spark, far, run_rows, broadcast_rows):
    """Null and repeated ids with different texts, ids far apart, and copies among them."""
    rng = random.Random(8)
    passages = [prose(30, rng) for _ in range(6)]
    rows = [(i - far if i % 2 else i + far, f"{prose(20, rng)} {passages[i % 6]} {prose(5, rng)}") for i in range(8)]
    rows += [(9, prose(40, rng)), (9, passages[0] + prose(20, rng)), (9, passages[0]), (9, None), (9, prose(40, rng) + passages[5])]
    rows += [(None, prose(50, rng)), (None, passages[1] + prose(9, rng)), (None, passages[1] + rows[-1][1]), (None, passages[1]), (None, passages[1])]
    rows += [rows[0], (3 - far, rows[8][1]), (None, rows[2][1]), (1 << 62, rows[9][1] + "!")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, doc int").repartition(3)
    got = repeats.remove_repeats(df, run_rows=run_rows, broadcast_rows=broadcast_rows).collect()
    same(got, [(d, *x) for (d, _), x in zip(rows, brute.repeats(rows))])
    assert any(r.n_removed == 0 for r in got if r.doc_id is None) and any(r.n_removed == 0 for r in got if r.doc_id == 9)


@pytest.mark.parametrize("shard,block", [(2 << 20, 8 << 20), (200, 400)])
def test_items_count_once_by_their_id(spark, shard, block):
    """Items in several rows, items that share windows, items without an id, and the longest match of each document."""
    a, b, c = prose(30), prose(16), prose(13)
    items = [(7, a), (7, b), (8, b), (None, c), (None, b), (9, a), (9, a), (10, prose(4) + " " + " ".join(a.split()[5:25])), (11, " ".join(a.split()[:4]))]
    docs = [(1, f"x {a} y {b}"), (2, " ".join(a.split()[3:20])), (3, c + " " + c), (4, b.translate({c: c - 32 for c in range(97, 123)})), (None, a), (1, "nothing here"), (5, None), (6, " ".join(a.split()[:12]))]
    tables = spark.createDataFrame([(*r, "z") for r in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.benchmark_matches(*tables, shard_bytes=shard, block_bytes=block).collect()
    named = [("" if i is None else i, t) for i, t in items]
    same([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got], [(d, *brute.contamination(t, named)) for d, t in docs])
    longest = {r.n_words: tuple(r.longest) if r.longest else None for r in got}
    assert longest[48] == (1, 30, "7") and longest[17] == (0, 17, "7") and longest[26] == (0, 13, "") and longest[16] == (0, 16, "")
    assert longest[30] == (0, 30, "7") and longest[2] is None and longest[0] is None and longest[12] == (0, 4, "11")
    assert {p.item_id for r in got if r.n_words == 26 for p in r.places} == {""}
    bare = decontaminate.benchmark_matches(*tables, shard_bytes=shard, block_bytes=block, with_places=False).collect()
    same([(r.doc_id, r.n_hit, r.items_sha256, r.places) for r in bare], [(r.doc_id, r.n_hit, r.items_sha256, None) for r in got])


def test_many_items_of_one_window_are_not_listed_place_by_place():
    import time

    shared = prose(13)
    tests = decontaminate.TestSuffixes([(i, f"{shared} {i}x".encode()) for i in range(5000)], 13)
    began = time.time()
    (n,), ((starts, which),) = decontaminate.match_documents([" ".join([shared] * 300).encode()], tests)
    assert (n, len(starts)) == (3900, 300) and len(tests.owners(which[0])) == 5000 and time.time() - began < 2


def test_vocabularies_of_any_size_are_told_apart():
    words = np.random.default_rng(5).integers(1, 1 << 31, (1000, 3)).astype(np.uint64)
    assert len(np.unique(decontaminate._head_hash(words, 3))) == 1000


@pytest.mark.parametrize("n", [1, 255, 256, 257, 600])
def test_spans_of_many_matches_are_placed_right(spark, n):
    text = "é " + " ü, ".join(f"a{i}@example.org" for i in range(n)) + " end"
    row = disclosure.base_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(b.start, b.kind_no, b.kind, b.end) for b in row.base] == brute.base_spans(text)
    spans = [{"start": b.start, "kind_no": 0, "kind": "removed" if i % 3 else "email", "end": b.end, "value": b.value} for i, b in enumerate(row.base)]
    df = spark.createDataFrame([(text, spans)], f"text string, spans {disclosure.SPANS}")
    expected, at = "", 0
    for s in spans:
        expected += text[at : s["start"]] + ("[EMAIL]" if s["kind"] == "email" else "")
        at = s["end"]
    assert df.select(disclosure.redacted(F.col("text"), F.col("spans"))).first()[0] == expected + text[at:]
    assert spark.createDataFrame([("none", [])], f"text string, spans {disclosure.SPANS}").select(disclosure.redacted(F.col("text"), F.col("spans"))).first()[0] == "none"


def test_fifty_thousand_matches_in_one_text_take_seconds(spark):
    import time

    text = " ".join(f"person{i}@example.org" for i in range(50_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    disclosure.base_spans(df.where("false")).collect()
    began = time.time()
    assert disclosure.base_spans(df).select(F.size("base")).first()[0] == 50_000
    assert time.time() - began < 20


def plain_disclosing_terms(rows, support=2, generalise=0.9, remove=0.98):
    """{term: (disclosure, action)} of (doc_id, text) rows whose entities are e-mail addresses between blanks."""
    total = len(rows)
    near, entities, terms = {}, {}, {}
    for row, (_, text) in enumerate(rows):
        words = (text or "").split(" ")
        for w in {w.lower() for w in words if w and "@" not in w}:
            terms.setdefault(w, set()).add(row)
        for i, w in enumerate(words):
            if "@" in w:
                entities.setdefault(w.lower(), set()).add(row)
                left, right = " ".join(words[:i]), " ".join(words[i + 1 :])
                for t in {t.lower() for t in (*words[:i], *words[i + 1 :]) if t}:
                    held = near.setdefault((w.lower(), t), (set(), set()))
                    held[0].add(row)
                    held[1].add((left, right))
    out = {}
    for (entity, term), (both, contexts) in near.items():
        p = len(entities[entity]) / total
        if len(contexts) >= support and (len(term) >= 3 or len(both) >= support) and p < 1:
            told = math.log2(min(1.0, len(both) / len(terms[term])) / p) / -math.log2(p)
            if told >= generalise and told > out.get(term, (0, ""))[0]:
                out[term] = (told, "remove" if told >= remove else "generalise")
    return out


def test_disclosing_terms_are_the_plain_ones(spark):
    """Rows, repeated ones too, are counted one by one in every count."""
    rng = random.Random(4)
    filler = [f"word{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choices(filler, k=4))) for i in range(40)]
    rows += [(100 + i, f"{rng.choice(filler)} zorblax ann@example.org {rng.choice(filler)}") for i in range(4)]
    rows += [(200 + i, f"{rng.choice(filler)} mostly bob@example.org") for i in range(5)] + [(300, "mostly alone"), (301, None)]
    rows += [rows[40]] * 3 + [(None, "zorblax ann@example.org")] + [(300, "mostly alone")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    base = disclosure.sanitise.__globals__["settle"](disclosure.base_spans(docs), "spans")
    got = {r.term: (pytest.approx(r.disclosure), r.action) for r in disclosure.disclosing_terms(docs, base).collect()}
    expected = plain_disclosing_terms(rows)
    assert expected == got and "zorblax" in got


def test_mixing_stage_keeps_columns_of_any_name(spark):
    rows = [(i, prose(5), "en", f"s{i % 3}", 5, 70 + i, "c", "d", i, "n", "r", "x") for i in range(12)] + [(None, prose(5), "en", "s0", 5, 0, "c", "d", 0, "n", "r", "x")]
    names = ["_copy int", "_copies string", "_doc string", "id int", "copies string", "row string", "`a.b` string"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(names))
    got = selection.mixed(docs)
    assert got.columns == docs.columns
    assert {tuple(r) for r in got.collect()} <= set(rows) and got.count() >= 12


def test_many_ids_are_not_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(5), f"s{i % 3}") for i in range(12)] + [(5, prose(5), "s0")], "doc_id long, text string, source string")
    plain = [selection.without(docs, docs.where("doc_id < 7").select("doc_id")), selection.mixed(docs), selection.keep_one_of_each(docs)]
    monkeypatch.setattr(selection, "FEW", -1)
    many = [selection.without(docs, docs.where("doc_id < 7").select("doc_id")), selection.mixed(docs), selection.keep_one_of_each(docs)]
    assert all("Broadcast" in plan_of(x) for x in plain)
    assert all("Broadcast" not in plan_of(x) for x in many)
    for a, b in zip(plain, many):
        same(a.select("doc_id", "source").collect(), b.select("doc_id", "source").collect())
