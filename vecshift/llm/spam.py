"""Pages of repeated keywords, link lists and tags (problem 8).

A page is cut into blocks of lines. Bagged decision trees predict each block from measures of its content and links
that know no language: how often its words recur in the page, how long its words and lines are, where sentences end, which signs
it is made of. They are trained on weak labels that come from other evidence: rules on function words and on the share of
text within links, tags, log lines, code and tables, which are applied to a bounded sample of pages only. Where the trees
are unsure of a block, the spam rate of the page's host, as predicted over all its pages, tips the balance; the page's prediction
is the share of its text in blocks predicted as spam.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecshift.functions.staging import checkpoint

#: Words after which a block ends at the next line or sentence.
BLOCK_WORDS = 40
#: Texts with fewer words are too short to be spam.
LEAST_WORDS = 20
#: Pages at most, and of their labelled blocks, on which the trees are fitted, drawn by hash.
FIT_PAGES, FIT_ROWS = 10_000, 20_000
TREES, DEPTH, SEED = 25, 8, 11
#: Blocks with a probability between these are unsure; the odds of a host's rate against the overall one count for them to this
#: power. Pages that the overall rate counts for in each host's.
UNSURE, HOST_POWER, HOST_PRIOR = (0.2, 0.8), 0.5, 20.0
#: A page is spam if the share of its text that is spam is above this.
HALF = 0.5
#: A bigram is repeated if it occurs so often in its page.
REPEATED = 3

# Frequent function words of the four languages.
FUNCTION_WORDS = frozenset(
    """the of and to in a is it that was for on with as at by from this be are or an not which one had were but they their so
    than when after before into because our we you i he she if no out only between each most its would could can may has have did do
    how many much more still both there here what who whose why while through over under about until again also then these those some any all other
    der die das und ist im zu den von mit dem des ein eine einen einem einer nicht auf sich es als bei nach war für wird um zwei oft vor über aus
    wenn wer hat sie er wir ihr zum zur ohne damit was dass solange wie viele mehr je davon dagegen deren dessen kein keine keinen hatte hatten wurde werden sind
    beiden beide bis unter zwischen während obwohl bitte etwas niemand nur noch schon auch aber doch man dieser diese dieses dieselbe dann rund selten weil am an ob seit durch gegen
    el la los las lo de del que y en un una unos unas por con para se al su sus como más antes entre sin fue sobre desde hasta ya dos son si muy nadie es no ni o le les
    cuando porque aunque donde cada hay casi nunca sigue cuya cuyo cerca algo este esta estos estas todo todos tras durante mientras
    le et est dans pour qui sur au aux du pas par plus ne ce avant après sans sont avec lors deux mieux il elle on dont malgré une des ces cette cet leur leurs
    personne environ depuis chez rien tout tous car entre sous à été où ou mais l d n s c j m t qu""".split()
)

#: Markup that is no link.
MARKUP = regex.compile(r"</?(?!a\b)[A-Za-z][^<>]*>")
URL = regex.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+")
ANCHOR = regex.compile(r"<a\b[^>]*>.*?</a>|\[[^\]\n]*\]\([^)\s]*\)", regex.S)
HIDDEN_DOMAIN = regex.compile(r"\b[\p{L}\p{N}-]{3,63}(?:\s?\.\s?|\[\.\]|\(\.\))(?:com|net|org|info|example|test|invalid|[a-z]{2,3})\b(?:\s*[-–:]\s*[^\n]*)?")
HASHTAG = regex.compile(r"#[\p{L}_][\p{L}\p{N}_-]*")
PAIR = regex.compile(r"\b[\p{L}_]+:[\p{L}\p{N}_]+(?:;|,|$)", regex.M)
WORD = regex.compile(r"[\p{L}][\p{L}\p{M}]*")
LOG = regex.compile(r"^\W{0,2}\d{4}-\d\d-\d\d[T ]\d\d:\d\d.*$", regex.M)
CODE = regex.compile(r"^(?:[ \t]{2,}\S.*|.*[{};]|\s*(?:def|class|import|from|return|for|if|while|function|const|let|var|SELECT|INSERT)\b.*[:({=;].*)$", regex.M)
TABLE = regex.compile(r"^\s*\|.*\|\s*$", regex.M)
SETTING = regex.compile(r"^\s*(?:[-*]\s*)?`?[\w.-]+`?\s*(?:=|:\s|\().*$", regex.M)
BULLET = regex.compile(r"[•►→✓★▪◆●|/]|(?<=\s)-(?=\s)")
END = regex.compile(r"(?<=[.!?…])\s+")

#: What the weak labels are made of, and what the trees see of a block: nothing is in both.
EVIDENCE = ("function_words", "links", "tags", "repeated", "top_words", "distinct", "digits", "log", "code", "table", "setting", "separators", "commas", "words_a_line", "page_zip", "page_distinct")
FEATURES = (
    "once", "often", "own_distinct", "words_by_line", "comma", "ends", "word_length", "short_words", "long_words", "letters", "hash", "slash", "colon", "dot", "bracket", "bar", "dash", "equal",
    "digit", "line_length", "line_spread", "words", "page_once", "page_words", "page_entropy", "page_top",
)
#: A word recurs often in a page from so many times on.
OFTEN = 4
LETTERS, SENTENCE_END, DIGITS, PARAGRAPH = re.compile(r"[^\W\d_]+"), re.compile(r"[.!?…](?=\s|$)"), re.compile(r"\d+"), re.compile(r"\n\s*\n")


def blocks_of(text: str) -> list[str]:
    """The text in blocks: paragraphs, longer ones cut after BLOCK_WORDS words at a line or sentence end, or else at a blank."""
    blocks = []
    for paragraph in PARAGRAPH.split(text):
        part, words = [], 0
        for line in paragraph.split("\n"):
            for sentence in END.split(line) if len(line) > 200 else [line]:
                pieces = sentence.split(" ")
                for start in range(0, len(pieces), 2 * BLOCK_WORDS):
                    piece = " ".join(pieces[start : start + 2 * BLOCK_WORDS])
                    part.append(piece)
                    words += min(len(pieces) - start, 2 * BLOCK_WORDS)
                    if words >= BLOCK_WORDS:
                        blocks.append("\n".join(part))
                        part, words = [], 0
        if "".join(part).strip():
            blocks.append("\n".join(part))
    return [b for b in blocks if b.strip()]


def _covered(pattern, text: str, *signs: str) -> int:
    """Characters of the text within matches; none if it has none of the ``signs`` that every match has."""
    if signs and not any(sign in text for sign in signs):
        return 0
    return sum(m.end() - m.start() for m in pattern.finditer(text))


def plain_page(text: str | None) -> str:
    """The text without markup, entities and character width; empty if it is null or too short to be spam."""
    if not text:
        return ""
    if "<" in text:
        text = MARKUP.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    short = len(text) < 200 and len(text.split()) < LEAST_WORDS and len(LETTERS.findall(text)) < LEAST_WORDS
    return "" if short else text


def block_features(page: str) -> list[tuple[int, list[float]]]:
    """(characters, FEATURES) of each block of a plain page."""
    blocks = blocks_of(page)
    words = [LETTERS.findall(block.casefold()) for block in blocks]
    counts = Counter(w for own in words for w in own)
    total = max(sum(counts.values()), 1)
    entropy = -sum(n / total * math.log(n / total) for n in counts.values()) / math.log(max(total, 2))
    whole = [sum(n == 1 for n in counts.values()) / total, len(counts) / total, entropy, max(counts.values(), default=0) / total]
    out = []
    for block, own in zip(blocks, words, strict=True):
        n, k = len(block), max(len(own), 1)
        once = often = short = long = letters = 0
        for w in own:
            c, size = counts[w], len(w)
            once += c == 1
            often += c >= OFTEN
            short += size <= 3
            long += size >= 8
            letters += size
        lines = [len(line) for line in block.split("\n") if line.strip()]
        mean = sum(lines) / max(len(lines), 1)
        spread = math.sqrt(sum((x - mean) ** 2 for x in lines) / max(len(lines), 1))
        sign = block.count
        signs = [sign("#"), sign("/"), sign(":"), sign("."), sign("(") + sign("[") + sign("{"), sign("|") + sign("•") + sign("*"), sign("-"), sign("=")]
        digits = sum(map(len, DIGITS.findall(block)))
        row = [once / k, often / k, len(set(own)) / k, len(own) / max(len(lines), 1), sign(",") / k, len(SENTENCE_END.findall(block)) / k, letters / k, short / k, long / k, letters / n]
        out.append((n, [*row, *(x / k for x in signs), digits / n, mean, spread / max(mean, 1.0), float(len(own)), *whole]))
    return out


def block_evidence(text: str) -> list[list[float]]:
    """EVIDENCE of each block of a plain page."""
    if not text:
        return []
    words = [w.casefold() for w in WORD.findall(text)]
    pairs, counts = Counter(zip(words, words[1:])), Counter(w for w in words if w not in FUNCTION_WORDS)
    top = {w for w, n in counts.most_common(12) if n >= REPEATED}
    raw = text.encode("utf-8", "surrogatepass")
    packed = len(zlib.compress(raw, 1)) / len(raw)
    page = [packed, len(counts) / max(sum(counts.values()), 1)]
    out = []
    for block in blocks_of(text):
        n = len(block)
        plain = ANCHOR.sub(" ", block) if "<a" in block or "](" in block else block
        anchors = n - len(plain)
        free = URL.sub(" ", plain) if "http" in plain or "www." in plain else plain
        stripped = HASHTAG.sub(" ", free) if "#" in free else free
        stripped = PAIR.sub(" ", stripped) if ":" in stripped else stripped
        own = [w.casefold() for w in WORD.findall(block)]
        bare = own if stripped is block else [w.casefold() for w in WORD.findall(stripped)]
        grams = list(zip(own, own[1:]))
        k = max(len(own), 1)
        content = [w for w in own if w not in FUNCTION_WORDS]
        links = anchors + _covered(URL, plain, "http", "www.") + _covered(HIDDEN_DOMAIN, free, ".")
        out.append(
            [
                sum(w in FUNCTION_WORDS for w in bare) / max(len(bare), 1),
                min(links / n, 1.0),
                (_covered(HASHTAG, block, "#") + _covered(PAIR, block, ":")) / n,
                sum(pairs[g] >= REPEATED for g in grams) / max(len(grams), 1),
                sum(w in top for w in content) / max(len(content), 1),
                len(set(own)) / k,
                sum(map(str.isdigit, block)) / n,
                _covered(LOG, block, "-") / n,
                _covered(CODE, block) / n,
                _covered(TABLE, block, "|") / n,
                _covered(SETTING, block, "=", ":", "(") / n,
                len(BULLET.findall(block)) / k,
                block.count(",") / k,
                len(own) / (block.count("\n") + 1),
                *page,
            ]
        )
    return out


def weak_label(f: dict[str, float]) -> int:
    """1 for blocks that are spam beyond doubt, 0 for blocks that are none, -1 for others."""
    made = max(f["log"], f["code"], f["table"])
    if made > 0.5 and f["links"] < 0.3 and f["tags"] < 0.3:
        return 0
    if f["links"] > 0.6 or f["tags"] > 0.6:
        return 1
    keywords = f["function_words"] < 0.16 and f["digits"] < 0.2 and f["setting"] < 0.5
    if keywords and (f["repeated"] > 0.6 and f["function_words"] < 0.12 or f["top_words"] > 0.65 and f["page_distinct"] < 0.35):
        return 1
    if f["repeated"] > 0.8 and f["page_zip"] < 0.25 and f["top_words"] > 0.5:
        return 1
    if f["function_words"] > 0.2 and f["repeated"] < 0.65 and f["page_zip"] > 0.36 and f["links"] < 0.3 and f["tags"] < 0.2:
        return 0
    return -1


def block_table(pages: DataFrame, labelled: bool) -> DataFrame:
    """``(doc_id, host, chars, FEATURES...[, label])``: one row per block of each page of ``(doc_id, host, text)``."""

    def features(batches):
        for batch in batches:
            ids, hosts, chars, rows, labels = [], [], [], [], []
            for key, host, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                page = plain_page(text)
                for n, row in block_features(page) if page else ():
                    ids.append(key)
                    hosts.append(host)
                    chars.append(n)
                    rows.append(row)
                if labelled and page:
                    labels += [weak_label(dict(zip(EVIDENCE, row, strict=True))) for row in block_evidence(page)]
            matrix = np.array(rows, np.float32).reshape(-1, len(FEATURES))
            arrays = [pa.array(ids, pa.int64()), pa.array(hosts, pa.string()), pa.array(chars, pa.int32()), *[pa.array(matrix[:, j]) for j in range(len(FEATURES))]]
            names = ["doc_id", "host", "chars", *FEATURES]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(labels, pa.int8())] if labelled else arrays, names=[*names, "label"] if labelled else names)

    return pages.mapInArrow(features, "doc_id bigint, host string, chars int, " + ", ".join(f"{f} float" for f in FEATURES) + ", label tinyint" * labelled)


def fit_trees(blocks: DataFrame) -> RandomForestClassificationModel | None:
    """Bagged trees on at most about FIT_ROWS weakly labelled blocks; None if there is only one kind of label."""
    labelled = blocks.where("label >= 0")
    kinds = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(kinds) < 2:
        return None
    # as many of either kind, as far as there are; drawn by hash, so the sample doesn't depend on the partitions
    part = F.when(F.col("label") == 1, min(1.0, FIT_ROWS / 2 / kinds[1])).otherwise(min(1.0, FIT_ROWS / 2 / kinds[0]))
    draw = F.pmod(F.xxhash64("doc_id", *FEATURES), F.lit(1_000_000)) < part * 1_000_000
    sample = _assembled(labelled.where(draw)).select("doc_id", "features", F.col("label").cast("double").alias("label"))
    sample = sample.repartition(1).sortWithinPartitions("doc_id", F.xxhash64(vector_to_array("features"))).select("features", "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", subsamplingRate=1.0, minInstancesPerNode=5, seed=SEED).fit(sample)


def _assembled(blocks: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(blocks)


def page_scores(documents: DataFrame) -> DataFrame:
    """``(doc_id, host, share, host_rate, unsure)`` of each page long enough: the share of its text predicted as spam, after
    smoothing; the rate of spam pages of its host before it, and the share of text in blocks the trees are unsure of. Pages
    without a host are not smoothed. Where the sample has no blocks of one kind, the weak labels decide.

    documents: ``doc_id, text, origin``. Of rows that repeat a doc_id the shares are averaged by length."""
    pages = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(F.trim("origin")).alias("host"), "text")
    part = min(1.0, FIT_PAGES / max(pages.count(), 1))
    drawn = pages.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < math.ceil(part * 1_000_000))
    model = fit_trees(checkpoint(block_table(drawn, True)))
    if model is None:
        scored = block_table(pages, True).withColumn("p", F.greatest("label", F.lit(0)).cast("double"))
    else:
        scored = model.transform(_assembled(block_table(pages, False))).withColumn("p", vector_to_array("probability")[1])
    unsure = F.col("p").between(*UNSURE)
    size = F.col("chars").cast("double")
    whole = scored.groupBy("doc_id").agg(
        F.max("host").alias("host"),
        F.sum(size).alias("chars"),
        F.sum(F.when(F.col("p") > HALF, size).otherwise(0.0)).alias("first"),
        F.sum(F.when((F.col("p") > HALF) & ~unsure, size).otherwise(0.0)).alias("sure"),
        F.collect_list(F.when(unsure, F.struct("p", size.alias("size")))).alias("open"),
    )
    whole = checkpoint(whole)
    spam = (F.col("first") > HALF * F.col("chars")).cast("double")
    overall = whole.agg(F.coalesce(F.avg(spam), F.lit(0.0)).alias("overall"))
    hosts = whole.where("host is not null").groupBy("host").agg(F.sum(spam).alias("n_spam"), F.count("*").alias("n")).crossJoin(F.broadcast(overall))
    rate = (F.col("n_spam") + HOST_PRIOR * F.col("overall")) / (F.col("n") + HOST_PRIOR)
    odds = lambda p: F.greatest(p, F.lit(1e-6)) / F.greatest(1 - p, F.lit(1e-6))
    hosts = hosts.select("host", rate.alias("host_rate"), F.pow(odds(rate) / odds(F.col("overall")), F.lit(HOST_POWER)).alias("tip"))
    known = whole.join(hosts, "host", "left").withColumn("tip", F.coalesce("tip", F.lit(1.0)))
    # the factor is a column, not an expression within the lambda
    tipped = F.aggregate(F.transform("open", lambda b: F.when(odds(b["p"]) * F.col("tip") > 1, b["size"]).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    doubt = F.aggregate("open", F.lit(0.0), lambda s, b: s + b["size"])
    return known.select("doc_id", "host", ((F.col("sure") + tipped) / F.col("chars")).alias("share"), "host_rate", (doubt / F.col("chars")).alias("unsure"))


def spam_pages(documents: DataFrame) -> DataFrame:
    """``(doc_id)``: the pages more than half of whose text is repeated keywords, links or tags.

    Null, empty and very short texts are none; texts are read whole."""
    return page_scores(documents).where(F.col("share") > HALF).select("doc_id")
