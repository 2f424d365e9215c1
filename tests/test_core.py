"""Core operators against literal results and plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.functions import labels as L
from lexispark.functions import text as T
from lexispark.operators import association, dictionary, fusion, pooling, retrieval, scoring, spans, splits, tuning

GOLD = "record_id bigint, groups array<array<string>>"
PREDS = "system_name string, record_id bigint, codes array<string>"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_text(spark):
    df = spark.createDataFrame([(1, "  Άσκι της—ΚΑΙ\tx² "), (2, None), (3, "")], "id int, t string")
    got = rows(df.select("id", F.coalesce(T.normalize_text(F.col("t"), True), F.lit("NULL")).alias("n"), F.coalesce(T.clean_text(F.col("t")), F.lit("NULL")).alias("c")), "id", "n", "c")
    assert got == [(1, "ασκι τησ και x", "Άσκι τηςΚΑΙ x"), (2, "NULL", "NULL"), (3, "", "")]


def test_ngrams_and_chunks(spark):
    df = spark.createDataFrame([("a b c",), ("",)], "t string")
    got = [sorted(r[0]) for r in df.select(T.ngrams(T.tokenize(F.col("t")), 2)).collect()]
    assert got == [["a", "a b", "b", "b c", "c"], []]
    for n in (0, 1, 5, 6, 7, 11):
        starts = spark.range(1).select(T.chunk_starts(F.lit(n), 5, 3)).first()[0]
        want, i = [0], 0
        while i + 5 < n:
            i += 3
            want.append(i)
        assert starts == want


def test_scores_against_loop(spark):
    rng = random.Random(3)
    codes = list("abcdef")
    gold = [(i, [[rng.choice(codes) for _ in range(rng.randrange(3))] for _ in range(rng.randrange(4))]) for i in range(60)]
    preds = [(s, i, sorted(set(rng.choices(codes, k=rng.randrange(4))))) for s in ("x", "y") for i in range(70) if rng.random() < 0.8]
    g, p = spark.createDataFrame(gold, GOLD), spark.createDataFrame(preds, PREDS)
    truth = dict(gold)
    want = []
    for s, i, cs in preds:
        if i in truth:
            tp = sum(bool(set(x) & set(cs)) for x in truth[i])
            want.append((s, i, tp, len(set(cs) - {c for x in truth[i] for c in x}), len(truth[i]) - tp))
    assert rows(scoring.score_documents(g, p), "system_name", "record_id", "tp", "fp", "fn") == sorted(want)
    total = sum(len(x) for _, x in gold)
    for r in scoring.micro(g, p).collect():
        tp = sum(w[2] for w in want if w[0] == r["system_name"])
        assert (r["tp"], r["fn"]) == (tp, total - tp)


def test_scores_of_empty_tables(spark):
    g, p = spark.createDataFrame([], GOLD), spark.createDataFrame([], PREDS)
    for df in (scoring.micro(g, p), scoring.breakdown(g, p), scoring.error_counts(g, p), scoring.per_class(g, p, spark.createDataFrame([("a",)], "code string"))):
        assert df.count() == 0
    assert scoring.mcnemar(g, p, "x", "y").first() == (0, 0, 0, 0)


def test_mcnemar_p():
    assert math.isnan(scoring.mcnemar_p(0, 0))
    assert scoring.mcnemar_p(12, 12) == 1.0
    assert scoring.mcnemar_p(88, 21) == pytest.approx(2.588e-10, rel=1e-3)


def test_label_expressions(spark):
    df = spark.createDataFrame([(1, [["a", None, " "], None, ["b", "a"]]), (2, None), (3, [[]])], "id int, g array<array<string>>")
    assert rows(df.select("id", F.array_join(L.flatten_labels("g"), "").alias("x"), F.size(L.groups("g")).alias("n")), "id", "x", "n") == [(1, "ab", 2), (2, "", 0), (3, "", 1)]
    closed = spark.createDataFrame([(["x"],), (["q"],)], "c array<string>").select(F.array_join(L.close(F.col("c"), [(["x"], ["y"]), (["y"], ["z"])]), "")).collect()
    assert [r[0] for r in closed] == ["xyz", "q"]


def test_dictionary(spark):
    raw = spark.createDataFrame([("Στένωση", "A|B"), ("ΣΤΕΝΩΣΗ ", "C"), (" ", "D"), (None, "E"), ("νωση", "F")], "term string, codes_pipe_sep string")
    d = dictionary.load(raw)
    assert rows(d.select("term", F.array_join("codes", "").alias("c")), "term", "c") == [("νωση", "F"), ("στενωση", "ABC")]
    texts = spark.createDataFrame([(1, "ήπια στένωση."), (2, None), (3, ""), (1, "ήπια στένωση.")], "record_id bigint, text string")
    assert set(rows(dictionary.match(texts, d), "record_id", "term")) == {(1, "στενωση")}
    assert set(rows(dictionary.match_by_join(texts, d), "record_id", "term")) == {(1, "στενωση")}
    assert set(rows(dictionary.match_substring(texts, d), "record_id", "term")) == {(1, "στενωση"), (1, "νωση")}
    assert dictionary.match(texts, d.where("false")).count() == 0
    r = dictionary.partial_ratio
    assert [round(x, 4) for x in (r("abcd", "xxabxdxx"), r("abcd", "xxabcdxx"), r("abcd", "bcd"), r("abcd", "xyz"), r("abcdef", "xxxabcd"), r("νεφρωσικο συνδρομο", "νεφρωσικα συνδρομα"))] == [75.0, 100.0, 100.0, 0.0, 80.0, 91.4286]


def test_fusion(spark):
    p = lambda rows_: spark.createDataFrame(rows_, "record_id bigint, code string")
    a, b, c = p([(1, "x"), (1, "y"), (1, "x")]), p([(1, "y"), (2, "z")]), p([(2, "z")])
    assert rows(fusion.union(a, b), "record_id", "code") == [(1, "x"), (1, "y"), (2, "z")]
    assert rows(fusion.intersection(a, b), "record_id", "code") == [(1, "y")]
    assert rows(fusion.k_of_n([a, b, c], 9), "record_id", "code") == []
    assert rows(fusion.k_of_n([a, b, c], 2), "record_id", "code") == [(1, "y"), (2, "z")]
    for bad in ({"slug": "s", "op": "xor", "inputs": ["a", "b"]}, {"slug": "s", "op": "union", "inputs": ["a"]}, {"slug": "s", "op": "k_of_n", "inputs": ["a", "b"]}, {"op": "union", "inputs": ["a", "b"]}):
        with pytest.raises(ValueError):
            fusion.parse_compositions([bad])
    assert fusion.compose(fusion.Composition("s", "union", ("a", "q")), {"a": a}) is None


def test_pooling(spark):
    c = spark.createDataFrame([(1, 0, "a", 1.0), (1, 1, "a", -3.0), (1, 2, "a", None)], "record_id bigint, chunk_ix int, code string, logit double")
    sig = lambda x: 1 / (1 + math.exp(-x))
    want = {"max": sig(1), "mean": sig(-1), "mean_max": sig(0), "lme": sig(math.log((math.exp(1) + math.exp(-3)) / 2))}
    for how, v in want.items():
        assert pooling.pool(c, how).first()["score"] == pytest.approx(v)


def test_spans(spark):
    s = "record_id bigint, span_start int, span_end int"
    a = spark.createDataFrame([(1, 0, 5), (1, 10, 12)], s)
    b = spark.createDataFrame([(1, 1, 3), (1, 0, 5), (1, 8, 13), (2, 0, 1), (1, 4, 6)], s)
    assert rows(spans.merged(a, b), "record_id", "span_start", "span_end") == [(1, 0, 5), (1, 4, 6), (1, 8, 13), (2, 0, 1)]
    want = [x for x in rows(b, "record_id", "span_start", "span_end") if not any(y[0] == x[0] and y[1] <= x[1] and y[2] >= x[2] for y in rows(a, "record_id", "span_start", "span_end"))]
    assert rows(spans.uncontained(b, a), "record_id", "span_start", "span_end") == want
    t = spark.createDataFrame([(1, "aa bb  cc dd")], "record_id bigint, text string")
    g = spark.createDataFrame([(1, 0, 5), (1, 7, 9), (1, 7, 9)], s)
    assert rows(spans.bio(t, g), "token_ix", "label") == [(0, "B"), (1, "I"), (2, "B"), (3, "O")]
    assert rows(spans.decode(spans.bio(t, g).withColumn("p", F.lit(1.0))), "first_token", "last_token") == [(0, 1), (2, 2)]


def test_dictionary_spans_keep_original_offsets():
    import ahocorasick

    a = ahocorasick.Automaton()
    for x in ("ινωση", "οξεια ινωση"):
        a.add_word(x, x)
    a.make_automaton()
    text = "Ο ασθενής: Οξεία  ΊΝΩΣΗ"
    assert [(text[i:j], t) for i, j, t in spans.dictionary_spans(text, a)] == [("Οξεία  ΊΝΩΣΗ", "οξεια ινωση"), ("ΊΝΩΣΗ", "ινωση")]
    assert spans.dictionary_spans("παρίνωση", a) == [] and spans.dictionary_spans("", a) == []


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(1)
    e = rng.normal(size=(5, 3))
    score = lambda p: spans.START[p[0]] + e[0][p[0]] + sum(spans.TRANSITIONS[a][b] + e[i + 1][b] for i, (a, b) in enumerate(zip(p, p[1:])))
    paths = list(itertools.product(range(3), repeat=5))
    assert tuple(spans.viterbi(e, spans.TRANSITIONS, spans.START)) == max(paths, key=score)
    assert spans.log_partition(e, spans.TRANSITIONS, spans.START) == pytest.approx(np.logaddexp.reduce([score(p) for p in paths]))


def test_threshold_sweep_against_loop(spark):
    rng = random.Random(5)
    gold = [(i, [[rng.choice("abc")] for _ in range(2)]) for i in range(20)]
    cells = [(i, c, rng.random()) for i in range(20) for c in "abcd"]
    got = {r["threshold"]: (r["tp"], r["fp"]) for r in tuning.threshold_sweep(spark.createDataFrame(cells, "record_id bigint, code string, score double"), spark.createDataFrame(gold, GOLD), [0.2, 0.5, 0.8]).collect()}
    for t, v in got.items():
        p = {(i, c) for i, c, s in cells if s >= t}
        flat = {(i, c) for i, gs in gold for g in gs for c in g}
        assert v == (sum(any((i, c) in p for c in g) for i, gs in gold for g in gs), len(p - flat))


def test_bm25_against_loop(spark):
    docs = [("A", 0, ["x", "y", "x"]), ("B", 1, ["y", "z"]), ("C", 2, ["z"])]
    q = [(1, ["x", "y", "y", "unknown"]), (2, []), (3, ["z"])]
    hits = retrieval.bm25(spark.createDataFrame(docs, "code string, corpus_ix int, tokens array<string>"), spark.createDataFrame(q, "record_id bigint, tokens array<string>"), 5)
    n, avg = 3, 2.0
    df = {"x": 1, "y": 2, "z": 2}
    want = {}
    for rid, ts in q:
        for code, _, d in docs:
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in ts if t in d)
            if s:
                want[rid, code] = s
    assert {(r["record_id"], r["code"]): pytest.approx(r["score"]) for r in hits.collect()} == want
    assert rows(hits.where("record_id = 3"), "code", "rank") == [("B", 2), ("C", 1)]


def test_rare_placement(spark):
    x = [(1, "a"), (1, "b"), (2, "b"), (3, "c"), (3, "b")]
    got = splits.rare_placement(spark.createDataFrame(x, "record_id bigint, code string"))
    place = {i: s for i, s, _ in got}
    assert place[1] == "train" and place[3] == "train" and place[2] == "test"


def test_association(spark):
    g = spark.createDataFrame([(1, [["a", "b"]]), (2, [["a"], ["b"]]), (3, [["a"]])], GOLD)
    assert rows(association.jaccard(g, 5), "code_a", "code_b", "both") == [("a", "b", 2)]
    assert rows(association.rules(g, 1, 0.9), "code_a", "code_b", "probability") == [("b", "a", 1.0)]


def test_queries_have_the_columns_of_their_sql():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "dict_group_f1" in e.queries()


def ratio(a, b):
    """By the table of common subsequences."""
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def frames(a, b):
    """Windows of the longer string as long as the shorter one, with its beginnings and ends; the shorter string is what they are compared with."""
    return [b[max(0, i) : i + len(a)] for i in range(1 - len(a), len(b))]


def test_fuzzy_fallback_against_all_comparisons(spark):
    rng = random.Random(5)
    descriptions = [("A1", "αρρυθμια"), ("A2", "στενωση αορτης"), ("A3", "χρονια νεφρικη νοσος"), ("A4", "ab"), ("A5", "βρογχικο ασθμα")]
    texts = ["ασθενης με αρρυθμηα σημερα", "στενοση αορτις", "", None, "βρογχικοασθμα"]
    for _ in range(150):
        t = list("xx " + rng.choice(descriptions)[1] + " yy")
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(t))
            t[i : i + 1] = rng.choice(("", "q", "qa"))
        texts.append("".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "record_id bigint, text string")
    got = {tuple(r) for r in dictionary.fuzzy_fallback(df, spark.createDataFrame(descriptions, "code string, description string")).collect()}
    plain = dictionary.normalize_text
    norm = {r[0]: r[1] for r in df.select("record_id", plain(F.col("text"), fold_sigma=True)).collect() if r[1]}
    assert got == {(i, c) for i, s in norm.items() for c, d in descriptions if len(d) >= 4 and max(ratio(*p) for x, y in [sorted((d.replace("ς", "σ"), s), key=len)] for p in ((x, w) for w in frames(x, y))) >= 85}
    assert {(0, "A1"), (1, "A2")} <= got  # no word of these is spelt alike


def test_fuzzy_fallback_query_reads_whole_texts(spark, tmp_path):
    from lexispark.plans import q_dictionary

    long = "ο ασθενης προσηλθε με χρονεια νεφρηκη νοσο και στενοση αορτης"
    schema = "record_id bigint, patient_id bigint, split string, source string, text string, document_level_annotations array<array<string>>, labels_flat array<string>"
    spark.createDataFrame([(1, 1, "train", "x", long, [], []), (2, 1, "train", "x", "στενωση αορτης", [], [])], schema).write.parquet(f"{tmp_path}/records.parquet")
    spark.createDataFrame([("A2", "στένωση αορτής"), ("A3", "χρόνια νεφρική νόσο")], "code string, greek_description string").write.parquet(f"{tmp_path}/code_lookup.parquet")
    spark.createDataFrame([("στένωση αορτής", "A2")], "term string, codes_pipe_sep string").write.parquet(f"{tmp_path}/term_dictionary.parquet")
    spark.createDataFrame([(7, 1, None)], "mention_id bigint, record_id bigint, mention string").write.parquet(f"{tmp_path}/mentions.parquet")
    assert (1, "A3") in rows(q_dictionary.fuzzy_fallback(spark, str(tmp_path)), "record_id", "code")
