"""Training-data operators against brute force and literal cases."""

import itertools
import random
import unicodedata

import numpy as np
import pytest

from lexispark.llm import confusables, cooccur, fmindex, identifiers, leakage, overlap, packing, residue, termcount, textkernel


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def words(text):
    return ["".join(g) for k, g in itertools.groupby(text, str.isalnum) if k]


def test_kernel_compares_words_as_defined():
    w = textkernel.Words(["Καλή-μέρα", "ΚΑΛΗ μερα", "", "κaλη µέρα", "κα​λή", "ﬁx １２"])
    h = [w.hash[a:b].tolist() for a, b in zip(w.first[:-1], w.first[1:])]
    assert h[0] == h[1] and h[2] == [] and h[4] == h[0][:1] and len(h[5]) == 2
    assert h[5] == textkernel.Words(["fix 12"]).hash.tolist()
    assert textkernel.rejoin("νυχτε-\nρινό x-y") == "νυχτερινό x-y"


def test_index_finds_all_runs():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 6, n).astype(np.uint64) for n in (30, 1, 17, 8)]
    ix = fmindex.FMIndex(docs, sample=3)
    q = rng.integers(0, 7, 40).astype(np.uint64)
    at, lo, hi = ix.backward(q, np.zeros(40, np.int64), 3)
    got = {(a, int(s), int(p)) for a, x, y in zip(at, lo, hi) for s, p in zip(*ix.locate(np.arange(x, y)))}
    want = {(i, d, j) for i in range(38) for d, x in enumerate(docs) for j in range(len(x) - 2) if (x[j : j + 3] == q[i : i + 3]).all()}
    assert got == want


def brute_overlap(recs):
    runs = {}
    for rid, split, text in recs:
        if rid is not None and split and text:
            w = words(text)
            s = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
            if s:
                runs[rid] = (split, s)
    return sorted((min(a, b), max(a, b)) for a, b in itertools.combinations(runs, 2) if (runs[a][0] == "train") != (runs[b][0] == "train") and 2 * len(runs[a][1] & runs[b][1]) >= min(len(runs[a][1]), len(runs[b][1])))


def test_overlap_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    recs = []
    for i in range(120):
        text = rng.choices(vocab, k=rng.choice((12, 60, 150)))
        recs.append((i, rng.choice(("train", "val")), " ".join(text)))
        if rng.random() < 0.4:
            copy = [w if rng.random() > 0.04 else "zz" for w in text]
            if rng.random() < 0.5:
                copy = rng.choices(vocab, k=20) + copy + rng.choices(vocab, k=30)
            recs.append((1000 + i, rng.choice(("train", "test")), " ".join(copy)))
    recs += [(5000, "val", None), (5001, "train", ""), (5002, "val", "a b"), (None, "val", recs[0][2]), (5003, None, recs[0][2]), recs[0]]
    recs += [(6000 + i, "train" if i % 2 else "val", " ".join(vocab[:50])) for i in range(30)]  # one group of copies
    df = spark.createDataFrame(recs, "record_id bigint, split string, text string").selectExpr("*", "1 as rep", "'x' as sig", "'s' as source")
    assert rows(overlap.split_overlap(df), "record_id_a", "record_id_b") == brute_overlap(recs)


@pytest.mark.parametrize("holders", [4_000_000, 20])
def test_overlap_of_texts_quoted_very_often(spark, monkeypatch, holders):
    """Runs that more than 64 pairs share: texts quoted by half, and near-copies that differ from each other; also with such runs spread over buckets."""
    from lexispark.llm import routing

    monkeypatch.setattr(routing, "HOT_HOLDERS", holders)
    rng = random.Random(9)
    draw = lambda k: " ".join(rng.choices([f"w{i}" for i in range(3000)], k=k))
    base = draw(64).split(" ")
    recs = [(0, "val", " ".join(base))]
    recs += [(1 + i, "train", f"{draw(40)} {' '.join(base[:40])} {draw(40)}") for i in range(70)]
    recs += [(100 + i, "train" if i % 2 else "test", " ".join(w if rng.random() > 0.04 else f"z{i}" for w in base)) for i in range(40)]
    recs += [(200 + i, "train" if i % 2 else "test", f"{draw(50)} {' '.join(base[20:45])}") for i in range(40)]
    df = spark.createDataFrame(recs, "record_id bigint, split string, text string")
    assert rows(overlap.split_overlap(df), "record_id_a", "record_id_b") == brute_overlap(recs)


def test_overlap_of_nothing(spark):
    assert overlap.split_overlap(spark.createDataFrame([], "record_id bigint, split string, text string")).count() == 0


def test_identifiers(spark):
    names = ["Θεανώ Νιζανερούδη", "Δ. Λαζβιδάκης", "Ορέστης Σαρτερίδης"]
    recs = []
    for i in range(30):
        n = names[i % 3]
        recs.append((i, f"Υπεύθυνος ιατρός: Δρ. {n}. Τηλ. επικοινωνίας +30 210 123 45{i:02d}. Κατοικία: οδός Ανεμώνης {i + 1}, 123 45 Άνω Βρύση."))
        recs.append((100 + i, f"Συνοδός: {n}, συγγενής. Τηλ. επικοινωνίας 210 765 43{i:02d}. ΑΜΚΑ: 010170-123{i:02d}, e-mail: a{i}@b.example. Θετικό σημείο Λαζβιδάκης. Συσκευή SN 123456789{i:02d}."))
    recs += [(900, None), (901, ""), (None, "x"), recs[0]]
    df = spark.createDataFrame(recs, "record_id bigint, text string")
    got = rows(identifiers.found(df), "record_id", "kind", "found_value")
    assert (100, "name", "Θεανώ Νιζανερούδη") in got and (101, "phone", "210 765 4301") in got and (3, "address", "οδός Ανεμώνης 4, 123 45 Άνω Βρύση") in got
    assert (102, "id_number", "010170-12302") in got and (102, "email", "a2@b.example") in got
    assert not [g for g in got if "SN" in g[2] or g[2].startswith("12345")] and len(got) == 30 * 3 + 30 * 4
    red = dict(rows(identifiers.redacted(df).where("text is not null"), "record_id", "text"))
    assert red[100].startswith("Συνοδός: [NAME], συγγενής. Τηλ. επικοινωνίας [PHONE].") and "σημείο Λαζβιδάκης" in red[100] and red[901] == ""


def test_confusables(spark):
    texts = [(1, "καλή μέρα και τις"), (2, "κaλή μέρα"), (3, "κα​λή"), (4, unicodedata.normalize("NFD", "καλή")), (5, "10 mg"), (6, "3 μg/L m² 5 °C — x"), (7, "１２ mg"), (8, None), (9, "")]
    df = spark.createDataFrame(texts * 2, "record_id bigint, text string")
    men = spark.createDataFrame([(1, "IIZ"), (2, "ΙΙΖ"), (3, "WQD-2"), (4, None)], "mention_id bigint, mention string")
    terms = spark.createDataFrame([("ιιζ", "A"), ("wqd-2", "B")], "term string, codes_pipe_sep string")
    assert rows(confusables.found(df, men, terms), "field_name", "row_key") == [("mention", 1), *(("text", i) for i in (2, 3, 4, 5, 7))]
    m = confusables.speller(df, "text", ["ιιζ"])
    forms = dict(rows(confusables.canonical_forms(df, "record_id", "text", m), "key", "canonical"))
    assert forms == {2: "καλή μέρα", 3: "καλή", 4: "καλή", 5: "10 mg", 7: "12 mg"}
    assert m.term("IIZ") == "ΙΙΖ" and m.term("ΙΙΖ") is None
    assert confusables.normalised(df, "record_id", "text", m).count() == len(texts) * 2


def test_characters_beyond_the_table():
    assert confusables.flags(["a\U000e0041b", "a\U000e0101b", "\U00020000", "\U0002f800", "ab"]).tolist() == [confusables.IGNORABLE] * 2 + [0, confusables.WIDTH, 0]
    w = textkernel.Words(["a\U000e0041b", "ab", "\U0002f800", "\u4e3d", "\U0001d7d8\U0001f600x"])
    h = [w.hash[a:b].tolist() for a, b in zip(w.first[:-1], w.first[1:])]
    assert h[0] == h[1] and h[2] == h[3] and len(h[4]) == 2


def test_gram_counts_against_brute_force(spark):
    rng = random.Random(6)
    seqs = [(i, rng.choices("abc", k=rng.randrange(8))) for i in range(200)]
    want = {}
    for _, s in seqs:
        grams = [tuple(s[i : i + n]) for n in (1, 2, 3) for i in range(len(s) - n + 1)]
        for g in grams:
            want.setdefault(g, [0, 0])[0] += 1
        for g in set(grams):
            want[g][1] += 1
    got = termcount.gram_counts(spark.createDataFrame(seqs, "id int, terms array<string>"), "terms", 3)
    assert {tuple(r["gram"]): [r["occurrences"], r["records"]] for r in got.collect()} == want
    assert termcount.gram_counts(spark.createDataFrame([], "id int, terms array<string>"), "terms", 3).count() == 0


@pytest.mark.parametrize("block", [2, 3, 64])
def test_pairs_against_brute_force(spark, block):
    rng = random.Random(7)
    baskets = [(i, rng.choices("abcdefgh", k=rng.randrange(12)) + [None] * (i % 2)) for i in range(60)] + [(99, None), *[(100 + i, list("hgfedcbaxyz")) for i in range(4)]]
    want = {}
    for _, b in baskets:
        for p in itertools.combinations(sorted({x for x in b or () if x}), 2):
            want[p] = want.get(p, 0) + 1
    got = cooccur.associations(spark.createDataFrame(baskets, "id int, items array<string>"), "items", block)
    assert {(r["a"], r["b"]): r["n_ab"] for r in got.collect()} == want


def test_best_fit():
    rng = random.Random(8)
    p = packing.BestFit(100, 4)
    sizes = [rng.randrange(1, 101) for _ in range(500)]
    bins = [b for i, n in enumerate(sizes) for b in p.add(i, n)] + p.rest()
    assert sorted(k for b in bins for k, _ in b) == list(range(500))
    assert all(sum(n for _, n in b) <= 100 for b in bins) and p.open <= 4
    assert packing.pieces(250, 100) == [100, 100, 50] and packing.pieces(100, 100) == [100]
    with pytest.raises(ValueError):
        p.add("x", 101)


def test_packing_keeps_every_token(spark):
    tok = pytest.importorskip("public_tokenizers")
    docs = [(i, "λέξη " * (1 + i * 7 % 90)) for i in range(80)] + [(500, None), (501, ""), (None, "x"), (502, "μακρύ κείμενο " * 400)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    budgets = spark.createDataFrame([(1, 128, 2), (2, 512, None)], "budget_id int, capacity_tokens int, reserved_tokens int")
    path = tok.path("byte_bpe_multi_50k.tiktoken")
    got = packing.pack(df, budgets, path, tok.PATTERN).collect()
    enc = packing.encoder(path, tok.PATTERN)
    for b, room in ((1, 126), (2, 512)):
        used, per = {}, {}
        for r in got:
            if r["budget_id"] == b:
                used[r["container"]] = used.get(r["container"], 0) + r["tokens"]
                per.setdefault(r["doc_id"], []).append(r["tokens"])
        assert max(used.values()) <= room
        for i, t in docs:
            if i is not None and t:
                n = len(enc.encode_ordinary(t))
                assert sum(per[i]) == n and (len(per[i]) == 1) == (n <= room)


def test_packing_budgets_beyond_the_bound(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    with pytest.raises(ValueError, match="budgets"):
        packing.pack(df, spark.range(packing.BUDGETS + 1).selectExpr("int(id) as budget_id", "9 as capacity_tokens", "0 as reserved_tokens"), "", "")


def test_tiling_is_greedy(spark):
    """Against the definition: the longest match of free words, earliest first, again and again."""

    def slow(a, b, least):
        ua, ub, out = [False] * len(a), [False] * len(b), []
        while True:
            best = (0, 0, least - 1)
            for i, j in itertools.product(range(len(a)), range(len(b))):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ua[i + n] and not ub[j + n]:
                    n += 1
                best = (i, j, n) if n > best[2] else best
            if best[2] < least:
                return out
            out.append(best)
            ua[best[0] : best[0] + best[2]] = ub[best[1] : best[1] + best[2]] = [True] * best[2]

    rng = random.Random(3)
    for _ in range(60):
        a, b = (np.array(rng.choices(range(10**9, 10**9 + rng.choice((2, 4, 20))), k=rng.randrange(40)), np.uint64) for _ in "ab")
        least = rng.choice((1, 2, 4))
        assert leakage.tile(a, b, least) == slow(a.tolist(), b.tolist(), least)
    period = np.arange(5000, dtype=np.uint64) % np.uint64(7)
    assert leakage.tile(period, period[3:], 12) == [(3, 0, 4997)]


def test_reordered_passages_are_covered(spark):
    w = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, " ".join(w[20:] + ["x"] + w[:10] + ["y"] + w[10:20])), (2, " ".join(w[:10]))], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(w))], "item_id bigint, text string")
    assert rows(leakage.leaks(docs, items, seed=6, coverage=0.5), "item_id", "doc_id", "tiles", "covered") == [(7, 1, 3, 30)]


def test_tiling():
    h = lambda s: textkernel.Words([s]).hash
    a, b = "a b c d e f g h", "x e f g h y a b c d"
    assert sorted(leakage.tile(h(a), h(b), 3)) == [(0, 6, 4), (4, 1, 4)]
    assert leakage.tile(h("a b"), h("a b"), 3) == []


def test_leaks_against_brute_force(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(50)]
    items = [(i, " ".join(rng.choices(vocab, k=40))) for i in range(12)] + [(90, None), (91, "w1 w2")]
    docs = []
    for i in range(80):
        w = rng.choices(vocab, k=60)
        if i % 3 == 0:
            part = items[i % 12][1].split()
            n, at = rng.randrange(8, 20), rng.randrange(20)
            w[10:10] = part[at : at + n]
        docs.append((i, " ".join(w)))
    docs += [(500, None), (501, ""), docs[0]]
    run = lambda t: {tuple(x) for x in zip(*(words(t)[k:] for k in range(12)))}
    want = sorted({(k, i) for k, t in items if t for i, x in docs if x and run(t) & run(x)})
    d, q = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items + items[:1], "item_id bigint, text string")
    assert rows(leakage.leaks(d, q), "item_id", "doc_id") == want
    assert rows(leakage.leaks(d, q, block_words=30), "item_id", "doc_id") == want  # several blocks
    broken = spark.createDataFrame([(7, "καλη​μέρα " + items[0][1].replace("w", "w-\nq", 1))], "doc_id bigint, text string")
    whole = spark.createDataFrame([(1, items[0][1].replace("w", "wq", 1))], "item_id bigint, text string")
    assert rows(leakage.leaks(broken, whole), "item_id", "doc_id") == [(1, 7)]


def test_residue(spark):
    clean = ["Η συσκευή εμφάνισε ένδειξη Error 17 στις 04/01/2020.", "No value: the assay was void (null result, repeat sample).", "Ύπνος «καλό», λόγος $ 12, κλίση 5%, <28 mmol/L [sic].", "Το τμήμα ενεργοποίησε JavaScript στην εφαρμογή."]
    bad = ["Ηλικία: {{ age }} έτη.", "Ύψος undefined cm.", "Error 503 - Gateway Timeout.", "lorem ipsum dolor sit amet elit", "Please enable JavaScript in your browser.", "test test test test test", "Πίεση __________ σήμερα.", "Σφάλμα 404: η σελίδα δεν υπάρχει πια εδώ.", "Δόση <εισάγετε ward> και #REF!"]
    docs = [(i, t) for i, t in enumerate(clean)] + [(100 + i, t) for i, t in enumerate(bad)] + [(200, None), (201, ""), (None, bad[0])]
    docs += [(300, "The requested record page could not be located on this old server today."), (301, "The requested page could not be located on this old server today.")]
    df = spark.createDataFrame(docs + docs[:2], "doc_id bigint, text string")
    got = [r[0] for r in rows(residue.residue(df), "doc_id")]
    assert [i for i in got if i < 200] == [100 + i for i in range(len(bad))]
    assert {300, 301} <= set(got)  # the first by its likeness to the second
    assert residue.without_residue(df).count() == df.count() - len(got)


def test_residue_spreads_to_all_alike_segments(spark):
    """Against all pairs: variants of a message in which one word of its form is another, so that only their likeness tells them."""
    texts = [first := "upstream server sent no ok to us so we go up by it as is"]
    for i in range(60):
        w = first.split(" ")
        w[i % 4] = f"q{chr(97 + i % 26)}{chr(97 + i // 26)}"
        texts.append(" ".join(w))
    w = textkernel.Words(texts, digits_alike=True)
    sim = residue.simhash(w.hash, w.rec, w.n)
    sets = [set(w.hash[a:b].tolist()) for a, b in zip(w.first[:-1], w.first[1:])]
    want, todo = {0}, [0]
    while todo:
        i = todo.pop()
        more = [j for j in range(len(texts)) if j not in want and int(sim[i] ^ sim[j]).bit_count() <= 16 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        want |= set(more)
        todo += more
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert len(want) > 50 and rows(residue.residue(df), "doc_id") == [(i,) for i in sorted(want)]


def test_no_form_of_residue_is_filtered_out():
    """A match of every form and of every alternative in it, and the wordings that once were, pass the filter."""

    def matches(parsed):
        out = [""]
        for op, arg in parsed:
            match str(op):
                case "LITERAL":
                    more = [chr(arg)]
                case "SUBPATTERN":
                    more = matches(arg[3])
                case "BRANCH":
                    more = [m for x in arg[1] for m in matches(x)]
                case "MAX_REPEAT" | "MIN_REPEAT":
                    more = [m * max(arg[0], n) for m in matches(arg[2]) for n in {arg[0], min(1, arg[1])}]
                case "IN":
                    k, v = arg[0]
                    more = {"NEGATE": ["a"], "CATEGORY": ["1" if "DIGIT" in str(v) else " " if "SPACE" in str(v) else "a"], "RANGE": [chr(v[0]) if str(k) == "RANGE" else ""]}.get(str(k)) or [chr(c) for o, c in arg if str(o) == "LITERAL"]
                case _:
                    more = [""]
            out = [a + b for a in out for b in more]
        return out

    for form in (*residue.PLACEHOLDER_FORMS, *itertools.chain(*residue.MESSAGES.values())):
        some = matches(residue._parser.parse(form))
        assert some and [m for m in some if not residue.suspicious(m)] == [], form
    lost = ["The requested page could not be found.", "401 - Unauthorized", "429 - Too many requests", "(enter name)", "(your name here)", "It does not work properly without cookies", "Ο ιστότοπος δεν λειτουργεί χωρίς ενεργά cookies", "sit amet consectetur adipiscing elit", "sed ut et"]
    assert [t for t in lost if not (residue.label(t)[0] and residue.suspicious(t))] == []
    assert residue.folded(unicodedata.normalize("NFD", "Η ΣΕΛΊΔΑ ς")) == "η σελιδα σ"


@pytest.mark.parametrize(("buckets", "runs", "met", "hits", "hot"), [(1, 10**6, 10**6, 1, 0), (5, 700, 10**6, 3, 0), (7, 300, 40, 8, 0), (5, 300, 10**6, 3, 12), (3, 300, 50, 1, 3), (7, 10**6, 10**6, 8, 1)])
def test_routing_over_many_flushes_and_buckets(monkeypatch, buckets, runs, met, hits, hot):
    """The packed steps run by hand with small flushes, many buckets and small blocks: every pair above the share is a candidate."""
    import pandas as pd

    from lexispark.llm import routing as r

    monkeypatch.setattr(r, "FLUSH_RUNS", runs)
    monkeypatch.setattr(r, "MET", met)
    rng = random.Random(buckets)
    draw = lambda k: rng.choices([f"w{i}" for i in range(60)], k=k)
    base, recs = draw(40), []
    for i in range(90):
        text = draw(rng.choice((4, 6, 30))) + base[: rng.choice((0, 12, 25, 40))] + draw(rng.choice((0, 9, 30)))
        recs.append((i, rng.choice((1, 2)), " ".join(text)))
    recs += [(200 + i, s, t) for i, s, t in recs[::9]] + [(300 + i, 3 - s, t) for i, s, t in recs[::10]]
    # runs that more than `hot` texts hold are spread
    h = np.concatenate([np.unique(textkernel.windows(textkernel.Words([x[2]]), 5)[0]) for x in recs])
    run, n = np.unique(h, return_counts=True)
    spread = r.Spread(run[n > hot], 1 + n[n > hot] // hot, buckets) if hot else None
    assert not hot or len(spread.run) > 20

    class Sent:
        value = spread

    packed, flush, number = [], r._Flush(0, buckets, spread), 0
    for i in range(0, len(recs), 3):
        part = recs[i : i + 3]
        flush.add(np.array([x[0] for x in part]), np.array([x[1] for x in part]), textkernel.Words([x[2] for x in part]))
        if flush.full:
            packed += flush.rows()
            number += 1
            flush = r._Flush(number, buckets, spread)
    packed += flush.rows() if flush.seen else []
    frame = r._frame(packed)
    known = pd.concat([r._bucket(buckets)((b,), g) for b, g in frame.groupby("bucket")])
    told = known[known["kind"].isin((r.FREQUENCIES, r.TEXTS))]
    chosen = pd.concat([r._settle(0.5, hits, Sent)((f,), g) for f, g in told.groupby("flush")])
    met_rows = [r._meet((b,), known[(known["kind"] == r.POSTINGS) & (known["bucket"] == b)], chosen[chosen["bucket"] == b]) for b in range(2 * buckets)]
    every = pd.concat([*met_rows, chosen[chosen["bucket"] < 0]])
    pairs = pd.concat([r._count((f,), g) for f, g in every.groupby("flush")])
    ids = {}
    texts = known[known["kind"] == r.TEXTS]
    for b in r._texts([__import__("pyarrow").RecordBatch.from_pydict({"f": texts["flush"].tolist(), "d": texts["data"].tolist()})]):
        for row in b.to_pylist():
            ids.setdefault((row["flush"], row["number"]), []).append(row["record_id"])
    got = {frozenset((x, y)) for p in pairs.itertuples() for x in ids[p.flush_a, p.number_a] for y in ids[p.flush_b, p.number_b]}
    want = {frozenset(p) for p in brute_overlap([(i, "train" if s == 1 else "val", t) for i, s, t in recs])}
    assert len(ids) < len(recs) and want <= got and len(want) > 100
    assert hits < 8 or len(got) < 90 * 45


def test_residue_in_wordings_not_used_for_its_forms():
    from heldout_residue import HELD_OUT, ORDINARY

    hit = lambda t: any(residue.suspicious(s) and residue.label(s)[0] for s in residue.CUT.split(t) if s)
    assert sum(map(hit, HELD_OUT)) >= 0.9 * len(HELD_OUT) and not any(map(hit, ORDINARY))


def test_identifiers_of_open_shapes(spark):
    """Spellings that no seed has are discovered by the contexts they share with seeds; the same shapes elsewhere are not."""
    recs = [(i, f"Τηλ. επικοινωνίας +30 210 123 45{i:02d}. ΑΜΚΑ: 010170-123{i:02d}, e-mail: a{i}@b.example. Συσκευή 9{i:02d}456789 σε λειτουργία.") for i in range(40)]
    recs += [
        (100, "Τηλ. επικοινωνίας 69 41 23 45 67."), (101, "Τηλ. επικοινωνίας +44 20 7946 0958."), (102, "123, e-mail: maria(a)mail.example, ώρα 10"), (103, "Ήρθε ο κύριος Παπαδάκης."), (104, "Mr. O'Brien was seen."),
        (105, "Lives at 12 Baker Street, London NW1 6XE."), (106, "Μένει οδός Ανεμώνης αρ. 12, 123 45 Βρύση."), (107, "ΑΜΚΑ - 01017012345"), (108, "ΑΜΚΑ ασθενούς: 010150 12345"), (109, "Α.Τ. ΑΒ 123456"), (110, "ΑΦΜ/ΔΟΥ 123456789"), (111, "Δρ. Γεώργιος Α. Παπαδόπουλος, παθολόγος"),
        (112, "Μέτρηση 69 41 23 45 67 μονάδων."), (113, "Πρωτόκολλο 123456789 της κλινικής."),
    ]
    got = [g for g in rows(identifiers.found(spark.createDataFrame(recs, "record_id bigint, text string")), "record_id", "kind", "found_value") if g[0] >= 100]
    assert got == [
        (100, "phone", "69 41 23 45 67"), (101, "phone", "+44 20 7946 0958"), (102, "email", "maria(a)mail.example"), (103, "name", "Παπαδάκης"), (104, "name", "O'Brien"), (105, "address", "12 Baker Street, London NW1 6XE"),
        (106, "address", "οδός Ανεμώνης αρ. 12, 123 45 Βρύση"), (107, "id_number", "01017012345"), (108, "id_number", "010150 12345"), (109, "id_number", "ΑΒ 123456"), (110, "id_number", "123456789"), (111, "name", "Γεώργιος Α. Παπαδόπουλος"),
    ]
