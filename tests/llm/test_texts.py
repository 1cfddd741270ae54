import numpy as np
import pytest
from pyspark.sql import functions as F

from vecshift.llm import leakage, mixing, spam

PASSAGE = "Both Yendundley and Branithley answer within 50063 milliseconds while Vornenkoley needs a second hop through Stellessador größer"


@pytest.mark.parametrize(
    "text",
    [
        PASSAGE,
        PASSAGE.upper(),
        "prefix " + PASSAGE.replace(" ", " \n"),
        PASSAGE.replace("milliseconds", "milli-\nseconds").replace("answer", "ans­wer"),
        PASSAGE.replace("Branithley", "<b>Branithley</b>").replace(" while", "&nbsp;while<br/>"),
        PASSAGE.replace("ö", "o").replace("while", "wh​ile"),
        "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in PASSAGE),
        PASSAGE.replace(" and", ", and -"),
        "x" * 50_000 + " " + " ".join(PASSAGE.split()[3:14]) + " tail",
    ],
)
def test_forms_of_a_passage(text):
    index = leakage.ItemIndex.build([(7, PASSAGE)])
    assert leakage.leaks([None, "", text, "nothing of the kind " * 20], index) == [(2, 7)]


@pytest.mark.parametrize("text", [" ".join(PASSAGE.split()[:9]), PASSAGE.replace("within", "in").replace("needs", "wants"), "x" + " ".join(PASSAGE.split()[:10]), " ".join(PASSAGE.split()[:10]) + "x", PASSAGE.replace("50063", "50 063").replace("hop", "ho p")])
def test_what_only_resembles(text):
    assert leakage.leaks([text], leakage.ItemIndex.build([(7, PASSAGE)])) == []


def test_leaks_against_brute_force(spark):
    random = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(random.choice(vocabulary, random.integers(5, 40)))) for i in range(30)] + [(100, None), (101, ""), (102, "   ")]
    texts = []
    for i in range(120):
        words = list(random.choice(vocabulary, 60))
        if i % 2:
            source = items[random.integers(0, 30)][1].split()
            n = random.integers(5, 16)
            words[10:10] = source[:n]
        texts.append((i, " ".join(words)))
    texts += [(500, None), (501, ""), (3, texts[3][1])]
    expected = set()
    for d, t in texts:
        words = (t or "").split()
        runs = {tuple(words[k : k + 10]) for k in range(len(words) - 9)}
        for i, p in items:
            w = (p or "").split()
            if any(tuple(w[k : k + 10]) in runs for k in range(len(w) - 9)):
                expected.add((d, i))
    documents = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("item_id", F.lit(1))
    frame = spark.createDataFrame(items, "item_id bigint, text string").withColumn("suite", F.lit("s"))
    found = leakage.contaminated(documents, frame).collect()
    assert {tuple(r) for r in found} == expected and len(found) == len(expected) > 10
    assert leakage.leaked_items(documents, frame).count() == len({i for _, i in expected})
    assert leakage.contaminated(documents.where("false"), frame).count() == 0
    assert leakage.contaminated(documents, frame.where("false")).count() == 0


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 100)
    items = spark.createDataFrame([(i, PASSAGE.replace("50063", str(i))) for i in range(9)], "item_id bigint, text string")
    documents = spark.createDataFrame([(1, PASSAGE.replace("50063", "4"))], "doc_id bigint, text string")
    assert (1, 4) in {tuple(r) for r in leakage.contaminated(documents, items).collect()}


def test_edits_are_aligned():
    index = leakage.ItemIndex.build([(7, PASSAGE)])
    changed = PASSAGE.replace("milliseconds", "miliseconds").replace(" second", " sekond")
    short = " ".join(changed.split()[3:13])
    assert leakage.leaks([short], index) == [] and leakage.leaks([short], index, strict=False) == [(0, 7)]
    assert leakage.leaks([short.replace("while", "wilhe")], index, strict=False) == []


def test_banded_distance():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)

    random, cases = np.random.default_rng(0), []
    for _ in range(200):
        a = random.integers(0, 3, random.integers(1, 12))
        b = np.concatenate([random.integers(0, 3, random.integers(0, 3)), a, random.integers(0, 3, random.integers(0, 3))])
        for _ in range(random.integers(0, 4)):
            b[random.integers(0, len(b))] = random.integers(0, 3)
        d = plain(a, b)
        cases.append((a, b, min(d, 4)))
    windows, regions = np.concatenate([a for a, _, _ in cases]), np.concatenate([b for _, b, _ in cases])
    a, b = (np.cumsum([0] + [len(c[j]) for c in cases]) for j in (0, 1))
    found = leakage.banded_distances(windows, (a[:-1], a[1:]), regions, (b[:-1], b[1:]), 3)
    assert found.tolist() == [d for _, _, d in cases]


def test_items_with_a_common_prompt(monkeypatch):
    prompt = "answer the following question about the text in not more than ten plain words please "
    index = leakage.ItemIndex.build([(n, prompt + f"what is item number {n} of the {n} long list of things to do") for n in range(60)])
    texts = [prompt + "nothing else", "what is item number 7 of the 7 long list of things", "no such thing", None]
    expected = leakage.leaks(texts, index)
    assert expected == [(0, n) for n in range(60)] + [(1, 7)]
    monkeypatch.setattr(leakage, "MOST_HITS", 100)
    monkeypatch.setattr(leakage, "ALIGNED", 13)
    assert leakage.leaks(texts, index) == expected


@pytest.mark.parametrize("text", ["Moving vectors, größer & 12.5 %\n\n" * 9000, "x" * 200_000, " " * 150_000, "\n" * 50_000, "向量" * 60_000, "1234567890" * 20_000])
def test_long_texts_are_counted_whole(text):
    assert mixing.count_tokens(text) == len(mixing._encoding(mixing.TOKENIZER).encode_ordinary(text)) > 0


def test_tokens():
    assert mixing.count_tokens(None) == mixing.count_tokens("") == 0 and mixing.count_tokens("a b") == 2


TARGETS = "mix_id string, source string, target_weight double, max_repeats int, total_tokens bigint"


def test_mixture_against_brute_force(spark):
    random = np.random.default_rng(1)
    names = ["web", "forum", " Forum-Threads ", "tiny", None]
    documents = [(i, " ".join(["word"] * int(random.integers(1, 60))), names[min(int(random.exponential(0.9)), 4)]) for i in range(600)]
    documents += [(9001, "", "web"), (9002, None, "web"), (9003, "lonely words", "tiny"), (None, "no id", "web"), documents[0]]
    targets = [("m", "web", 3.0, 1, 6000), ("m", "forum_threads", 1.0, 2, 6000), ("m", "tiny", 1.0, 2, 6000), ("m", "none", 1.0, None, 6000), ("n", "tiny", 1.0, None, 5000), ("n", "web", 0.0, 5, 5000), ("small", "web", 1.0, 1, 50), ("odd", "web", None, 1, 100), ("odd2", "web", 1.0, 0, 100), ("m", "web", 3.0, 1, 6000)]
    frame = spark.createDataFrame(documents, "doc_id bigint, text string, source string").withColumn("tokens", F.lit(1))
    mixture = mixing.Mixture(frame, spark.createDataFrame(targets, TARGETS))
    tokens = mixture.tokens.toPandas()
    chosen = mixture.selection().toPandas()
    shares = mixture.shares().toPandas().set_index(["mix_id", "source"])
    weights = {("m", "web"): 3 / 6, ("m", "forum_threads"): 1 / 6, ("m", "tiny"): 1 / 6, ("m", "none"): 1 / 6, ("n", "tiny"): 1.0, ("n", "web"): 0.0, ("small", "web"): 1.0, ("odd", "web"): 0.0, ("odd2", "web"): 1.0}
    totals = {"m": 6000, "n": 5000, "small": 50, "odd": 100, "odd2": 100}
    limits = {("m", "web"): 1, ("m", "forum_threads"): 2, ("m", "tiny"): 2, ("m", "none"): 10**9, ("n", "tiny"): 10**9, ("n", "web"): 5, ("small", "web"): 1, ("odd", "web"): 1, ("odd2", "web"): 0}
    for key, share in weights.items():
        own = tokens[tokens.source == key[1]].sort_values("place")
        budget, whole = int(share * totals[key[0]]), int(own.tokens.sum())
        copies = min(budget // whole, limits[key]) if whole else 0
        rest = budget - copies * whole if copies < limits[key] else 0
        part = own[own.tokens.cumsum() <= rest] if rest > 0 else own[:0]
        expected = {d: copies + (d in set(part.doc_id)) for d in own.doc_id if copies + (d in set(part.doc_id))}
        got = chosen[(chosen.mix_id == key[0]) & (chosen.source == key[1])]
        assert dict(zip(got.doc_id, got.repeats)) == expected
        assert shares.loc[key, "budget"] == budget and shares.loc[key, "tokens"] == (got.tokens * got.repeats).sum() <= budget
    small = set(chosen[chosen.mix_id == "small"].doc_id)
    assert small <= set(chosen[(chosen.mix_id == "m") & (chosen.source == "web")].doc_id)  # thresholds are nested


def test_mixture_of_nothing(spark):
    documents = spark.createDataFrame([], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("m", "web", 1.0, 1, 100)], TARGETS)
    mixture = mixing.Mixture(documents, targets)
    assert mixture.selection().count() == 0 and mixture.shares().first()["actual_share"] == 0
    assert mixing.Mixture(documents, targets.where("false")).shares().count() == 0


PROSE = "The night shift compared the scan worker with the ledger before cutover, so that the copy could go on without a loss. Nobody on the team expected that the page size had an effect on how often the cache was filled. It was {n} pages long, and most of them had no text at all because the import had left it out."


def page(kind, n):
    random = np.random.default_rng(n)
    words = ["cheap", "vector", "hosting", "best", "plugin", "buy", "booster"]
    if kind == "prose":
        nouns = ["worker", "ledger", "segment", "gate", "auditor", "replica", "tenant", "quota", "cursor", "norm", "shard", "alias", "budget"]
        pick = lambda: str(random.choice(nouns))
        parts = [f"In week {random.integers(1, 99)} the {pick()} of the {pick()} had to wait for a {pick()}, which was not what we had planned.", f"She asked whether the {pick()} could be moved to the {pick()} without the {pick()}.", f"Most of the {random.integers(9, 9999)} rows were in the {pick()} before it was closed by an {pick()}.", f"If you see the {pick()} again, tell us about the {pick()} and the time at which it came."]
        return " ".join(parts[i] for i in random.permutation(4)) + " " + PROSE.format(n=n)
    if kind == "keywords":
        return ", ".join(" ".join(random.choice(words, 3)) for _ in range(60))
    if kind == "links":
        return "\n".join(f"* [{random.choice(words)} {random.choice(words)}](https://site{random.integers(0, 99)}.example/{random.integers(0, 999)})" for _ in range(25))
    if kind == "tags":
        return " ".join("#" + "".join(w.title() for w in random.choice(words, 3)) for _ in range(50))
    return "\n".join(f"2025-0{random.integers(1, 9)}-11T0{random.integers(0, 9)}:10:00Z INFO worker-{random.integers(0, 9)} scan page={random.integers(0, 999)} ok" for _ in range(20))


def test_spam_on_held_out_pages(spark):
    kinds = ["prose"] * 6 + ["keywords", "links", "tags", "log"]
    rows = [(n, page(kinds[n % 10], n), f"host{n % 7}.example") for n in range(400)]
    mixed = [(1000 + n, page("prose", n) + "\n\n" + page("keywords", n)[:150], "host1.example") for n in range(20)]
    rows += mixed + [(2000, None, "x"), (2001, "", None), (2002, "buy now", None), (2003, "  \n ", "x"), (2004, page("keywords", 5), None), (2005, page("links", 6) * 400, "host0.example")]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, origin string").withColumn("label", F.lit("clash"))
    found = {r.doc_id for r in spam.spam_pages(documents).collect()}
    expected = {n for n in range(400) if kinds[n % 10] in ("keywords", "links", "tags")} | {2004, 2005}
    assert len(found & expected) >= 0.97 * len(expected) and len(found - expected) <= 0.03 * len(expected)
    assert not found & {r[0] for r in mixed}


def test_hosts_tip_unsure_blocks_only(spark, monkeypatch):
    kinds = {"sure": [0.95], "clean": [0.02], "unsure": [0.45], "half": [0.95, 0.02], "lean": [0.55]}

    def blocks(pages, labelled):
        rows = [(r.doc_id, r.host, 100, p) for r in pages.collect() for p in kinds[r.text]]
        return spark.createDataFrame(rows, "doc_id bigint, host string, chars int, label double")

    monkeypatch.setattr(spam, "block_table", blocks)
    monkeypatch.setattr(spam, "fit_trees", lambda blocks: None)
    rows = [(n, "sure", "spam.example") for n in range(60)] + [(n, "clean", "clean.example") for n in range(100, 300)]
    rows += [(400, "unsure", "spam.example"), (401, "unsure", "clean.example"), (402, "unsure", None), (403, "lean", "clean.example"), (404, "lean", None), (405, "half", "spam.example"), (406, "clean", "spam.example"), (407, "sure", "clean.example")]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, origin string")
    found = {r.doc_id for r in spam.spam_pages(documents).collect()}
    assert found == set(range(60)) | {400, 404, 407}


def test_labels_and_trees_see_different_things():
    assert not set(spam.EVIDENCE) & set(spam.FEATURES)
    for kind in ("prose", "keywords", "links", "tags", "log"):
        text = spam.plain_page(page(kind, 3))
        seen, evidence = spam.block_features(text), spam.block_evidence(text)
        assert len(seen) == len(evidence) >= 1 and all(len(row) == len(spam.FEATURES) and np.isfinite(row).all() for _, row in seen)
    assert [spam.plain_page(t) for t in (None, "", " \n ", "buy now")] == [""] * 4


def test_spam_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, origin string")
    assert spam.spam_pages(empty).count() == 0
    one = spark.createDataFrame([(1, page("keywords", 1), None)], "doc_id bigint, text string, origin string")
    assert [r.doc_id for r in spam.spam_pages(one).collect()] == [1]


def test_long_documents_are_searched_in_windows(monkeypatch):
    monkeypatch.setattr(leakage, "BATCH_CHARS", 300)
    index = leakage.ItemIndex.build([(7, PASSAGE), (8, "one two three four five six seven eight nine ten eleven")])
    for at in range(0, 400, 7):
        text = "filler " * at + PASSAGE + " filler" * 150
        assert leakage.leaks(["short", text, None], index) == [(1, 7)]
    assert leakage.leaks(["<!--" * 200_000 + PASSAGE, "a<!-- x --> " + PASSAGE], index) == [(0, 7), (1, 7)]
    assert leakage.leaks([(PASSAGE + " ") * 3000], index) == [(0, 7)]
