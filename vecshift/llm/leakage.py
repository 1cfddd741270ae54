"""Evaluation texts inside a training corpus (problem 6).

Q-gram lemma filtering: texts are reduced to their letters and digits; the character q-grams a document shares
with an item are counted in overlapping diagonal bands; a passage of n characters within k edits keeps at least
n + 1 - q - k * q of its q-grams in a stretch of one band, so bands with fewer are dropped. What is left is
verified by banded alignment: some words of the item, as many as make a passage, must stand in the text within the edit
budget. For the strict form, in which no edit is allowed, words are compared along the diagonal after that.
"""

from __future__ import annotations

import html
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecshift.functions.staging import stage

#: Consecutive words that make a leak.
WORDS = 10
#: Characters of a q-gram.
Q = 8
#: Characters of item texts indexed at a time: the index is broadcast, at about 20 bytes a character.
BLOCK_CHARS = 2_000_000
#: Characters of documents handled at a time; a longer document is handled whole, in windows that overlap by a passage.
BATCH_CHARS = 1_000_000
#: Edits within which a passage is retained and aligned; the strict form allows none in the end.
EDITS = 2
#: Shared q-grams looked at in one step; more are taken in several steps, by texts or by items.
MOST_HITS = 4_000_000
#: Alignments made at a time.
ALIGNED = 20_000
#: Bits of the table of q-grams looked at first.
TABLE_BITS = 22

# What is markup, a break within a word, or invisible.
TAG = regex.compile(r"</?[A-Za-z][^<>]*>")
BROKEN = regex.compile(r"[-­‐‑][^\S\n]*\r?\n\s*")
INVISIBLE = regex.compile(r"[\p{Mn}\p{Me}\p{Cf}\p{Default_Ignorable_Code_Point}]+")
WORD = regex.compile(r"[^\W_]+")
GAP = regex.compile(r"[\W_]+")
#: Stands where a word may or may not end: at a tag or a hyphen before a line end.
MAYBE = "\x01"


def plain_words(text: str | None) -> str:
    """The words of a text, without case, accents, punctuation, markup, entities, character width and invisible
    characters, parted by blanks, or by MAYBE where they may be parts of one word. Null has no words."""
    import unicodedata

    if not text:
        return ""
    if "<" in text:
        text = TAG.sub(MAYBE, _without_comments(text))
    if "&" in text:
        text = html.unescape(text)
    if "\n" in text:
        text = BROKEN.sub(MAYBE, text)
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKD", text))
        text = INVISIBLE.sub("", unicodedata.normalize("NFKD", text.casefold()))
    else:
        text = text.casefold()
    if MAYBE not in text:
        return " ".join(WORD.findall(text))
    return GAP.sub(lambda gap: MAYBE if set(gap[0]) == {MAYBE} else " ", text).strip(" " + MAYBE)


def _without_comments(text: str) -> str:
    parts, at = [], 0
    while (begin := text.find("<!--", at)) >= 0 and (end := text.find("-->", begin)) >= 0:
        parts += [text[at:begin], MAYBE]
        at = end + 3
    return "".join([*parts, text[at:]]) if parts else text


def letters(words: str) -> tuple[np.ndarray, np.ndarray]:
    """The characters of ``plain_words`` without gaps, and for each whether a word starts there: 0 no, 1 yes, 2 perhaps.
    The second array has one more entry, for the end."""
    codes = np.frombuffer(words.encode("utf-32-le"), np.uint32)
    gap = (codes == 32) | (codes == 1)
    kind = np.where(codes == 32, 1, np.where(codes == 1, 2, 0)).astype(np.int8)
    start = np.zeros(int((~gap).sum()) + 1, np.int8)
    at = np.flatnonzero(gap)
    start[at - np.arange(len(at))] = kind[at]
    start[0] = start[-1] = 1
    return codes[~gap], start


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each q-gram."""
    if len(codes) < Q:
        return np.empty(0, np.uint64)
    wide, n = codes.astype(np.uint64), len(codes) - Q + 1
    h = np.zeros(n, np.uint64)
    for j in range(Q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + wide[j : j + n]
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class ItemIndex:
    """Q-grams of items. grams: sorted; places of gram g are first[g]:first[g+1] of item and place. codes: the letters of all
    items, those of item i from begins[i] on."""

    ids: np.ndarray
    texts: list[tuple[np.ndarray, np.ndarray]]
    shortest: np.ndarray
    longest: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    table: np.ndarray
    codes: np.ndarray
    begins: np.ndarray

    @staticmethod
    def build(rows: list[tuple[int, str | None]]) -> ItemIndex:
        """Items with fewer than WORDS words can't be contained and are left out."""
        ids, texts, shortest, longest, hashes, item, place = [], [], [], [], [], [], []
        for key, text in rows:
            codes, start = letters(plain_words(text))
            borders = np.flatnonzero(start)
            if len(borders) <= WORDS or key is None:
                continue
            lengths = borders[WORDS:] - borders[:-WORDS]
            grams = gram_hashes(codes)
            item.append(np.full(len(grams), len(ids), np.int32))
            place.append(np.arange(len(grams), dtype=np.int32))
            hashes.append(grams)
            ids.append(key)
            texts.append((codes, start))
            shortest.append(int(lengths.min()))
            longest.append(int(lengths.max()))
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        flat = cat(hashes, np.uint64)
        order = np.argsort(flat, kind="stable")
        grams, first = np.unique(flat[order], return_index=True)
        table = np.zeros(1 << TABLE_BITS, bool)
        table[(grams >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        return ItemIndex(np.array(ids, np.int64), texts, np.array(shortest, np.int64), np.array(longest, np.int64), grams, np.append(first, len(flat)), cat(item, np.int32)[order], cat(place, np.int32)[order], table, cat([c for c, _ in texts], np.uint32), np.cumsum([0] + [len(c) for c, _ in texts]))

    def hits(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in codes, item, place in item) of each shared q-gram; those of a block of items at a time, so that there
        are not many more than MOST_HITS at once even if all items share a prompt."""
        h = gram_hashes(codes)
        at = np.flatnonzero(self.table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        if not len(at) or not len(self.grams):
            return
        g = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        same = self.grams[g] == h[at]
        at, g = at[same], g[same]
        n = self.first[g + 1] - self.first[g]
        blocks = max(1, -(-int(n.sum()) // MOST_HITS))
        if blocks == 1:
            yield self._expanded(at, g, n)
            return
        step = np.searchsorted(np.cumsum(n), np.arange(blocks + 1) * MOST_HITS)
        step[-1] = len(at)
        borders = np.linspace(0, len(self.ids), blocks + 1).astype(np.int64)
        for low, high in zip(borders[:-1], borders[1:], strict=True):
            parts = []
            for i, j in zip(step[:-1], step[1:], strict=True):
                place, item, own = self._expanded(at[i:j], g[i:j], n[i:j])
                inside = (item >= low) & (item < high)
                parts.append((place[inside], item[inside], own[inside]))
            yield tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _expanded(self, at: np.ndarray, g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        which = np.repeat(self.first[g] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(at, n), self.item[which].astype(np.int64), self.place[which].astype(np.int64)


def dense_bands(place: np.ndarray, group: np.ndarray, diagonal: np.ndarray, need: np.ndarray, reach: np.ndarray, width: int) -> np.ndarray:
    """The hits that begin a stretch of at least ``need`` hits of their group, within ``reach`` places and one of
    the overlapping bands of ``2 * width`` diagonals that start every ``width``."""
    keep = []
    for shift in (0, width) if width > 1 else (0,):
        band = (diagonal + shift) // (2 * width if width > 1 else 1)
        order = np.lexsort((place, band, group))
        g, b, p = group[order], band[order], place[order]
        new = np.append(True, (g[1:] != g[:-1]) | (b[1:] != b[:-1]) | (p[1:] != p[:-1]))
        order, g, b, p = order[new], g[new], b[new], p[new]  # a place counts once in a band
        last = np.arange(len(order)) + need[order] - 1
        inside = last < len(order)
        last = np.minimum(last, len(order) - 1)
        keep.append(order[inside & (g[last] == g) & (b[last] == b) & (p[last] - p <= reach[order])])
    return np.unique(np.concatenate(keep))


def words_in_line(codes: np.ndarray, start: np.ndarray, item: np.ndarray, item_start: np.ndarray, diagonal: int) -> int:
    """The most consecutive whole words of the item that stand in the text along a diagonal (place in text minus place in item)."""
    low, high = max(0, -diagonal), min(len(item), len(codes) - diagonal)
    if low >= high:
        return 0
    here = start[low + diagonal : high + diagonal + 1]
    wrong = codes[low + diagonal : high + diagonal] != item[low:high]
    inner = item_start[low:high] == 0
    wrong = wrong | inner & (here[:-1] == 1) | ~inner & (here[:-1] == 0)
    sums = np.concatenate([[0], np.cumsum(wrong)])
    borders = np.flatnonzero(item_start)
    borders = borders[(borders >= low) & (borders <= high)] - low
    if len(borders) < 2:
        return 0
    good = (sums[borders[1:]] == sums[borders[:-1]]) & (here[borders[1:]] != 0)
    ends = np.flatnonzero(np.concatenate([[True], ~good, [True]]))
    return int(np.diff(ends).max()) - 1


def banded_distances(letters_: np.ndarray, window: tuple[np.ndarray, np.ndarray], text: np.ndarray, region: tuple[np.ndarray, np.ndarray], most: int) -> np.ndarray:
    """For each alignment the least edits that turn a window into some part of a region, if at most ``most``; else ``most + 1``.

    window: (start, end) in ``letters_``; region: (start, end) in ``text``. Cells further than ``most`` from the
    diagonals on which a part may start and end are left out. All alignments take a row at a time."""
    (a, b), (low, high) = window, region
    n, m = b - a, high - low
    spread = int(np.maximum(0, m - n).max(initial=0)) + 2 * most
    offsets, over = np.arange(spread + 1), most + 1
    row = np.where((offsets - most >= 0) & (offsets - most <= m[:, None]), 0, over)  # row i holds text places i - most + offsets
    result = np.where(n == 0, 0, over)
    for i in range(1, int(n.max(initial=0)) + 1):
        places = i - most + offsets
        inside = (places >= 0) & (places <= m[:, None])
        letter = np.where(inside & (places >= 1), text[np.clip(low[:, None] + places - 1, 0, max(len(text) - 1, 0))], 0)
        own = letters_[np.minimum(a + i - 1, len(letters_) - 1)][:, None]
        best = np.minimum(row + ((letter != own) | (places < 1)), np.concatenate([row[:, 1:], np.full((len(row), 1), over)], axis=1) + 1)
        best = np.where(places == 0, i, np.where(inside, best, over))
        row = np.minimum.accumulate(best - offsets, axis=1) + offsets
        row = np.minimum(np.where(inside, row, over), over)
        result = np.where(n == i, row.min(1), result)
    return np.minimum(result, over)


def leaks(texts: list[str | None], index: ItemIndex, edits: int = EDITS, strict: bool = True) -> list[tuple[int, int]]:
    """(number of text, item id) of each text that contains WORDS consecutive words of an item."""
    return leaks_in_words([plain_words(t) for t in texts], index, edits, strict)


def leaks_in_words(texts: list[str], index: ItemIndex, edits: int = EDITS, strict: bool = True) -> list[tuple[int, int]]:
    """``leaks`` of texts given as ``plain_words`` makes them."""
    found = set()
    overlap = int(index.longest.max(initial=0)) + 4 * edits + Q
    for group in _by_size(texts):
        parts, owner = [], []
        for i in group:
            codes, start = letters(texts[i])
            for low in range(0, max(len(codes), 1), BATCH_CHARS):
                high = low + BATCH_CHARS + overlap
                parts.append((codes[low:high], start[low : high + 1]))
                owner.append(i)
        step = len(parts) if len(group) > 1 else 1  # the windows of a long text one by one
        for low in range(0, len(parts), step):
            found |= {(owner[low + t], item) for t, item in _leaks_in(parts[low : low + step], index, edits, strict)}
    return sorted(found)


def _leaks_in(parts: list[tuple[np.ndarray, np.ndarray]], index: ItemIndex, edits: int, strict: bool) -> list[tuple[int, int]]:
    """(number of part, item id) of each part that contains a passage."""
    found: list[tuple[int, int]] = []
    seen: set[tuple[int, int]] = set()
    gap = np.full(Q, 0, np.uint32)  # no gram runs from one text into the next unnoticed: grams with 0 are in no item
    flat = np.concatenate([x for c, _ in parts for x in (c, gap)])
    begins = np.cumsum([0] + [len(c) + Q for c, _ in parts])
    for at, item, item_place in index.hits(flat):
        text = np.searchsorted(begins, at, side="right") - 1
        place = at - begins[text]
        need = np.maximum(1, index.shortest[item] + 1 - Q - edits * Q)
        width = 2 * edits + 1
        kept = dense_bands(place, text * len(index.ids) + item, place - item_place, need, index.longest[item] + edits, width)
        for shift in (0, width) if width > 1 else (0,):
            size = 2 * width if width > 1 else 1
            diagonal = place - item_place
            band = (diagonal + shift) // size
            near = _alignments(text, item, band, item_place, kept, index, edits)
            ok = np.zeros(len(near[0]), bool)
            for low in range(0, len(ok), ALIGNED):
                nt, ni, nb, a, b = (x[low : low + ALIGNED] for x in near)
                start, end = begins[nt], begins[nt + 1] - Q
                first = np.clip(start + a + nb * size - shift - edits, start, end)
                last = np.clip(start + b + (nb + 1) * size - 1 - shift + edits, first, end)
                base = index.begins[ni]
                ok[low : low + ALIGNED] = banded_distances(index.codes, (base + a, base + b), flat, (first, last), edits) <= edits
            for nt, ni, nb in set(zip(*(x[ok].tolist() for x in near[:3]), strict=True)):
                if (nt, ni) in seen:
                    continue
                lines = np.unique(diagonal[(text == nt) & (item == ni) & (band == nb)]) if strict else ()
                if not strict or any(words_in_line(*parts[nt], *index.texts[ni], int(d)) >= WORDS for d in lines):
                    seen.add((nt, ni))
                    found.append((nt, int(index.ids[ni])))
    return found


def _alignments(text: np.ndarray, item: np.ndarray, band: np.ndarray, place: np.ndarray, kept: np.ndarray, index: ItemIndex, edits: int) -> tuple[np.ndarray, ...]:
    """(text, item, band, start, end) of the alignments to try: the windows of WORDS words of an item that have as many of their
    q-grams in a band of a text as ``edits`` edits leave, for bands in which there are ``kept`` hits."""
    if not len(kept):
        return (np.empty(0, np.int64),) * 5
    least, items = band.min(), len(index.ids)
    far = int(band.max() - least) + 1
    key = (text * items + item) * far + (band - least)
    names = np.unique(key[kept])
    group = np.minimum(np.searchsorted(names, key), len(names) - 1)
    inside = np.flatnonzero(names[group] == key)
    group, place = group[inside], place[inside]
    order = np.argsort(group, kind="stable")
    group, place = group[order], place[order]
    first = np.searchsorted(group, np.arange(len(names) + 1))
    of_item = names // far % items
    out = []
    for i in np.unique(of_item):
        own = np.flatnonzero(of_item == i)  # the bands of this item
        borders = np.flatnonzero(index.texts[i][1])
        a, b = borders[:-WORDS], borders[WORDS:]
        length = int(borders[-1]) + 1
        n = first[own + 1] - first[own]
        nth = np.repeat(np.arange(len(own)), n)
        hits = np.unique(nth * length + place[np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())])
        base = np.arange(len(own))[:, None] * length
        count = np.searchsorted(hits, base + np.maximum(b - Q + 1, a)) - np.searchsorted(hits, base + a)
        g, w = np.nonzero(count >= np.maximum(b - a + 1 - Q - edits * Q, 1))
        name = names[own][g]
        out.append(np.stack([name // far // items, np.full(len(g), i), name % far + least, a[w], b[w]]))
    return tuple(np.concatenate(out, axis=1))


def _by_size(texts):
    group, size = [], 0
    for i, text in enumerate(texts):
        if group and size + len(text or "") > BATCH_CHARS:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(text or "")
    if group:
        yield group


def contaminated(documents: DataFrame, items: DataFrame, edits: int = EDITS, strict: bool = True) -> DataFrame:
    """``(doc_id, item_id)``: the documents that contain at least WORDS consecutive words of an item's text.

    Regions within ``edits`` edits of such a passage are retained and aligned; unless ``strict`` they are cases, else only those
    with the very words. documents: ``doc_id, text``; items: ``item_id, text``; repeated rows count once. Null, empty or blank
    texts contain nothing, and shorter items are contained in nothing. Items are taken in blocks of BLOCK_CHARS
    characters, each broadcast; texts are read whole. One pass over the documents for each block, no shuffle but the last one;
    where there are several blocks, documents are brought into their plain form once and kept in the shared folder."""
    items = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    documents = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    several = blocks > 1

    def plain(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([plain_words(t) for t in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    if several:
        documents = stage(documents.mapInArrow(plain, "doc_id bigint, text string"), "plain")
    found = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow()
        index = documents.sparkSession.sparkContext.broadcast(ItemIndex.build(list(zip(rows["item_id"].to_pylist(), rows["text"].to_pylist(), strict=True))))

        def search(batches, index=index):
            look = leaks_in_words if several else leaks
            for batch in batches:
                ids = batch.column(0).to_pylist()
                cases = look(batch.column(1).to_pylist(), index.value, edits, strict)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in cases], pa.int64()), pa.array([j for _, j in cases], pa.int64())], names=["doc_id", "item_id"])

        part = documents.mapInArrow(search, "doc_id bigint, item_id bigint")
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(item_id, suite, documents)``: the items found in any document, and in how many."""
    counts = contaminated(documents, items).groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.select("item_id", "suite").distinct().join(counts, "item_id")
