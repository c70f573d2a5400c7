"""Operator 2: removing passages that repeat, by a hash-compared suffix sort.

A passage is WORDS words in a row (runs of bytes other than ASCII white space). Every passage that occurs again,
in another document or the same, keeps one occurrence, the first by (doc_id, row, place); the others are cut.

Suffixes meet in two steps, so that no more text is moved than may repeat:
1. In every run of WORDS words the GRAM words of least hash are its anchor. Equal passages have equal anchors,
   and only about one place in twenty is one. Anchors are shuffled as hashes and sorted, and a task reads them in
   a stream, however many are alike; those that occur once are done with.
2. The others' places are joined with the texts, and all passages with such an anchor are sent, as one stretch of text, to where its like go. Stretches
   that are the same byte for byte are taken together. The suffixes of the rest, beginning at each passage, are
   sorted by a merge sort. Two of them are compared by their longest common extension, found by binary search
   over prefix polynomial hashes, and by the word after it. Neighbours in order that have WORDS words or more in
   common are the same passage; their bytes are compared, so that no collision of hashes cuts anything.

Documents with a null doc_id or text are neither cut nor compared. Rows with the same doc_id and text are one
document, cut alike; with the same doc_id and other texts, several. Texts of fewer than WORDS words stay as
they are. A document that is cut to nothing goes. Repeats of a line or word in one text count as passages too. An
empty table gives an empty one. Columns of any name stay as they are: the operator's own get names that docs lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORDS, GRAM = 50, 12
#: A stretch has about so many bytes, and a task takes about so many of them.
STRETCH_BYTES, TASK_BYTES = 500, 32 << 20


def sliding(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over x[i : i + n] for each i; shorter at the end."""
    out, have = x.copy(), 1
    while have < n:
        step = min(have, n - have)
        out[:-step] = pick(out[:-step], out[step:])
        have += step
    return out


def least_at(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of x[i : i + n] for each i, and the last place that has it."""
    value, at, have = x.copy(), np.arange(len(x), dtype=np.int32), 1
    while have < n:
        step = min(have, n - have)
        later = value[step:] <= value[:-step]
        value[:-step] = np.where(later, value[step:], value[:-step])
        at[:-step] = np.where(later, at[step:], at[:-step])
        have += step
    return value, at


class Words:
    """The words of an Arrow text column: where they begin and end, their document, hash and gram hashes."""

    def __init__(self, array: pa.Array, words: int, gram: int):
        self.raw, starts = common.string_bytes(array)
        self.first, self.last = common.word_bounds(self.raw, starts[1:-1])
        self.begin = np.searchsorted(self.first, starts)
        hashes = common.word_hashes(self.raw, self.first, self.last)
        self.grams = common.gram_hashes(hashes, gram) | np.uint64(1)
        size = np.diff(self.begin)
        self.doc = np.repeat(np.arange(len(size)), size)
        #: Whether a passage begins at the word.
        self.whole = np.repeat(self.begin[1:], size) - np.arange(len(self.doc)) >= words
        self.windows = words - gram + 1

    def padded(self) -> np.ndarray:
        return np.concatenate([self.grams, np.full(len(self.doc) - len(self.grams), np.iinfo(np.uint64).max, np.uint64)])

    def anchors(self) -> np.ndarray:
        """The words at which an anchor begins."""
        if not self.whole.any():
            return np.zeros(0, np.int64)
        g = self.padded()
        least = np.where(self.whole, sliding(g, self.windows, np.minimum), np.uint64(0))
        # The greatest of the leasts of the windows that a gram is in: of those that begin up to windows - 1 before.
        most = sliding(np.concatenate([np.zeros(self.windows - 1, np.uint64), least]), self.windows, np.maximum)[: len(g)]
        return np.flatnonzero(most == g)


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(row, doc_id, text) of the documents that are compared; row tells documents apart."""
    ident, body = F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")
    return docs.where(ident.isNotNull() & body.isNotNull()).select(F.xxhash64(ident, body).alias("row"), ident.alias("doc_id"), body.alias("text"))


class Stretches:
    """Stretches of text with an anchor each: which of their passages are the same, and which occurrence is first."""

    def __init__(self, texts: pa.Array, group: np.ndarray, lead: np.ndarray, count: np.ndarray, words: int):
        """group: by anchor; lead: words before the anchor; count: passages, at the stretch's words 0, 1, ..."""
        self.words, self.count, self.lead = words, count, lead
        self.raw, starts = common.string_bytes(texts)
        self.first, self.last = common.word_bounds(self.raw, starts[1:-1])
        self.begin = np.searchsorted(self.first, starts)
        # Hashes need eight bytes for each byte of text, so the text is taken a slice at a time.
        cuts = np.unique(np.concatenate([[0], np.searchsorted(starts, np.arange(0, len(self.raw), common.SLICE_BYTES), side="right") - 1, [len(starts) - 1]]))
        hashes = [common.word_hashes(self.raw[starts[i] : starts[j]], self.first[(a := self.begin[i]) : (b := self.begin[j])] - starts[i], self.last[a:b] - starts[i]) for i, j in zip(cuts[:-1], cuts[1:])]
        self.hash = np.concatenate([np.zeros(0, np.uint64), *hashes])
        self.sums = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum(self.hash * common.kept_powers(common.BASE, len(self.hash)), out=self.sums[1:])
        self.inverse = common.kept_powers(common.BASE_INVERSE, len(self.hash) + 1)
        n = len(count)
        self.stretch = np.repeat(np.arange(n), count)
        self.offset = np.arange(len(self.stretch)) - np.repeat(np.cumsum(count) - count, count)
        #: Each passage's first word.
        self.at = self.begin[self.stretch] + self.offset
        self.end = self.begin[self.stretch + 1]
        # Only passages as far from the same anchor can be the same.
        self.key = group[self.stretch].astype(np.int64) * (2 * words) + (self.offset - lead[self.stretch] + words)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words passages a and b and what follows them have in common."""
        x, y = self.at[a], self.at[b]
        most = np.minimum(self.end[a] - x, self.end[b] - y)
        found = np.zeros(len(a), np.int64)
        step = 1 << int(most.max(initial=1)).bit_length()
        while step:
            to = found + step
            may = np.flatnonzero(to <= most)
            xs, ys, size = x[may], y[may], to[may]
            same = (self.sums[xs + size] - self.sums[xs]) * self.inverse[xs] == (self.sums[ys + size] - self.sums[ys]) * self.inverse[ys]
            found[may[same]] = size[same]
            step >>= 1
        return found

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix a comes before suffix b or is the same."""
        n = self.extension(a, b)
        x, y = self.at[a] + n, self.at[b] + n
        over_a, over_b = x >= self.end[a], y >= self.end[b]
        last = len(self.hash) - 1
        less = self.hash[np.minimum(x, last)] < self.hash[np.minimum(y, last)]
        return over_a | (~over_b & less)

    def sort(self) -> np.ndarray:
        """All passages by key, and by suffix within a key: merge sort, in all keys at a time."""
        order = np.argsort(self.key, kind="stable")
        k = self.key[order]
        begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(k)))
        width = 1
        while len(size) and width < size.max():
            here = np.flatnonzero(size > width)
            n = size[here]
            at = np.repeat(begin[here], n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            n = np.repeat(n, n)
            run = place // width
            right = run % 2 == 1
            base = (run - right) * width
            # The other run of the pair, and by binary search how many of it come before.
            lo = np.where(right, base, np.minimum(base + width, n))
            hi = np.where(right, base + width, np.minimum(base + 2 * width, n))
            start, own = lo.copy(), order[at + place]
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) // 2
                other = order[at[open_] + mid]
                is_right = right[open_]
                left_one, right_one = np.where(is_right, other, own[open_]), np.where(is_right, own[open_], other)
                first = self.before(left_one, right_one)
                past = np.where(is_right, first, ~first)
                lo[open_[past]] = mid[past] + 1
                hi[open_[~past]] = mid[~past]
            order[at + base + (place - run * width) + (lo - start)] = own
            width *= 2
        return order

    def same(self) -> np.ndarray:
        """For each passage the number of the passage that stands for all that are the same."""
        order = self.sort()
        a, b = order[:-1], order[1:]
        near = np.flatnonzero(self.key[a] == self.key[b])
        near = near[self.extension(a[near], b[near]) >= self.words]
        near = near[self._verified(a[near], b[near])]
        joined = np.zeros(len(order), bool)
        joined[near + 1] = True
        heads = np.flatnonzero(~joined)
        of = np.empty(len(order), np.int64)
        of[order] = np.repeat(order[heads], np.diff(np.append(heads, len(order))))
        return of

    def _verified(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether passages with the same hashes have the same words, byte by byte; once for each run of passages."""
        good = np.ones(len(a), bool)
        if not len(a):
            return good
        order = np.lexsort((self.offset[a], self.stretch[b], self.stretch[a]))
        x, y = a[order], b[order]
        cut = (self.stretch[x][1:] != self.stretch[x][:-1]) | (self.stretch[y][1:] != self.stretch[y][:-1]) | (np.diff(self.at[x]) != 1)
        begin = np.flatnonzero(np.concatenate([[True], cut]))
        for i, j in zip(begin, np.append(begin[1:], len(x))):
            p, q, n = self.at[x[i]], self.at[y[i]], j - i - 1 + self.words
            if not self._equal(p, q, n):
                good[order[i:j]] = [self._equal(self.at[c], self.at[d], self.words) for c, d in zip(x[i:j], y[i:j])]
        return good

    def _equal(self, p: int, q: int, n: int) -> bool:
        one, other = (self.raw[self.first[s] : self.last[s + n - 1]].tobytes() for s in (p, q))
        return one == other or one.split() == other.split()


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, gram: int = GRAM, scratch: common.Scratch | None = None) -> DataFrame:
    """(row, doc_id, start, end, kept_in): words start..end-1 of a document are passages that kept_in has before."""
    spark = docs.sparkSession
    common.ship(spark)
    scratch = scratch or common.Scratch(spark, "suffix")
    n = common.partitions(spark)
    rows = keyed(docs, doc_id, text)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches, "text"):
            w = Words(batch.column(1), words, gram)
            at = w.anchors()
            doc = w.doc[at]
            yield pa.RecordBatch.from_arrays([pa.array(w.grams[at].view(np.int64)), batch.column(0).take(pa.array(doc)), pa.array((at - w.begin[doc]).astype(np.int32))], names=["h", "row", "pos"])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come in order of (h, row, pos); the last one waits for what follows it.
        held, known = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)], False
        for batch in batches:
            h, row, pos = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate(held))
            # Rows that are in the table twice don't make an anchor a repeated one.
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1]) | (pos[1:] != pos[:-1])
            h, row, pos = h[new], row[new], pos[new]
            if not len(h):
                continue
            again = np.zeros(len(h), bool)
            again[1:] = h[1:] == h[:-1]
            again[:-1] |= again[1:]
            again[0] |= known
            held, known = [h[-1:], row[-1:], pos[-1:]], bool(again[-1])
            again[-1] = False
            yield pa.RecordBatch.from_arrays([pa.array(row[again]), pa.array(pos[again])], names=["row", "pos"])
        if known:
            yield pa.RecordBatch.from_arrays([pa.array(held[1]), pa.array(held[2])], names=["row", "pos"])

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches, "text"):
            w = Words(batch.column(2), words, gram)
            lists = batch.column(3)
            flat = lists.flatten().to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            wanted = np.zeros(len(w.doc) + 1, bool)
            wanted[np.repeat(w.begin[:-1], sizes) + flat] = True
            _, owner = least_at(w.padded(), w.windows)
            start = np.flatnonzero(w.whole)
            owner = owner[start]
            start, owner = start[wanted[owner]], owner[wanted[owner]]
            if not len(start):
                continue
            head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            count = np.diff(np.append(head, len(start)))
            start, owner = start[head], owner[head]
            lo, hi = w.first[start], w.last[start + count - 1 + words - 1]
            size = hi - lo
            offsets = np.concatenate([[0], np.cumsum(size)])
            data = w.raw[np.repeat(lo - offsets[:-1], size) + np.arange(offsets[-1])]
            text = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
            doc = w.doc[start]
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(w.grams[owner].view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array((start - w.begin[doc]).astype(np.int32)), pa.array((owner - start).astype(np.int32)), pa.array(count.astype(np.int32)), text],
                names=["h", "row", "doc_id", "start", "lead", "count", "text"],
            )

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        h, row, doc, start, lead, count = (np.concatenate([b.column(i).to_numpy() for b in parts]) for i in range(6))
        # The same bytes are the same stretch: Arrow compares them.
        coded = pa.chunked_array([b.column(6).cast(pa.large_binary()) for b in parts]).combine_chunks().dictionary_encode()
        code, texts = coded.indices.to_numpy(), coded.dictionary
        del parts
        order = np.lexsort((start, row, doc, lead, code, h))
        h, row, doc, start, lead, count, code = (x[order] for x in (h, row, doc, start, lead, count, code))
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (code[1:] != code[:-1]) | (lead[1:] != lead[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1])
        h, row, doc, start, lead, count, code = (x[keep] for x in (h, row, doc, start, lead, count, code))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (code[1:] != code[:-1]) | (lead[1:] != lead[:-1])
        head = np.flatnonzero(new)
        times = np.diff(np.append(head, len(h)))
        kind = np.repeat(np.arange(len(head)), times)
        _, group = np.unique(h[head], return_inverse=True)
        # Stretches whose anchor has others are compared; in any, the first occurrence is at its head.
        shared = np.bincount(group)[group] > 1
        total = np.cumsum(count[head]) - count[head]
        first = np.repeat(head, count[head])
        if shared.any():
            some = np.flatnonzero(shared)
            s = Stretches(texts.take(pa.array(code[head[some]])), group[some], lead[head[some]], count[head[some]], words)
            of = s.same()
            occurrence = head[some][s.stretch]
            place = start[occurrence] + s.offset
            rank = np.lexsort((place, row[occurrence], doc[occurrence], of))
            lead_of = np.ones(len(of), bool)
            lead_of[1:] = of[rank][1:] != of[rank][:-1]
            best = np.repeat(occurrence[rank[lead_of]], np.diff(np.append(np.flatnonzero(lead_of), len(of))))
            firsts = np.empty(len(of), np.int64)
            firsts[rank] = best
            first[np.repeat(total[some], count[head[some]]) + s.offset] = firsts
        # Runs of passages of a stretch that have the same first occurrence.
        stretch = np.repeat(np.arange(len(head)), count[head])
        cut = np.ones(len(first), bool)
        cut[1:] = (first[1:] != first[:-1]) | (stretch[1:] != stretch[:-1])
        run = np.flatnonzero(cut)
        length = np.diff(np.append(run, len(first)))
        runs = np.bincount(stretch[run], minlength=len(head))
        lowest = np.cumsum(runs) - runs
        each = runs[kind]
        occurrence = np.repeat(np.arange(len(h)), each)
        at = np.repeat(lowest[kind], each) + np.arange(len(occurrence)) - np.repeat(np.cumsum(each) - each, each)
        whose = first[run[at]]
        gone = whose != occurrence
        occurrence, at, whose = occurrence[gone], at[gone], whose[gone]
        begin = start[occurrence] + run[at] - total[kind[occurrence]]
        yield pa.RecordBatch.from_arrays([pa.array(row[occurrence]), pa.array(doc[occurrence]), pa.array(begin.astype(np.int32)), pa.array((begin + length[at] - 1 + words).astype(np.int32)), pa.array(doc[whose])], names=["row", "doc_id", "start", "end", "kept_in"])

    found = rows.select("row", "text").mapInArrow(common.forgetting(anchors), "h long, row long, pos int")
    found = found.repartition(n, "h").sortWithinPartitions("h", "row", "pos").mapInArrow(repeated, "row long, pos int")
    found = scratch.write(found.groupBy("row").agg(F.collect_list("pos").alias("at")), "anchors")
    # The texts are shuffled at every size, to where their anchors are, which are a fraction of them.
    # As many tasks as keep the stretches of each to about TASK_BYTES.
    places = found.agg(F.coalesce(F.sum(F.size("at")), F.lit(0))).first()[0]
    tasks = max(n, -(-int(places) * STRETCH_BYTES // TASK_BYTES))
    texts = rows.join(found.hint("shuffle_hash"), "row").select("row", "doc_id", "text", "at").mapInArrow(common.forgetting(stretches), "h long, row long, doc_id long, start int, lead int, count int, text binary")
    marked = scratch.write(texts.repartition(tasks, "h").mapInArrow(common.forgetting(marks), "row long, doc_id long, start int, end int, kept_in long"), "marks")
    # Marks that overlap or touch are one.
    by = Window.partitionBy("row", "kept_in").orderBy("start", "end")
    upto = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = marked.withColumn("new", F.when(F.col("start") <= upto, 0).otherwise(1)).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("row", "doc_id", "kept_in", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("row", "doc_id", "start", "end", "kept_in")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, gram: int = GRAM, length: str | None = None) -> DataFrame:
    """docs with the repeated passages cut from their texts; documents of which nothing is left go.

    length: names a column that has the text's characters, which are counted anew.
    """
    scratch = common.Scratch(docs.sparkSession, "suffix")
    found = repeated_passages(docs, doc_id, text, words, gram, scratch)
    row, starts, ends = common.fresh(docs, "row", "starts", "ends")
    cuts = scratch.write(found.groupBy(F.col("row").alias(row)).agg(F.collect_list("start").alias(starts), F.collect_list("end").alias(ends)), "cuts")
    scratch.drop("anchors", "marks")
    names = docs.columns
    schema = docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.text_slices(batches, text):
            column = batch.column(batch.schema.get_field_index(text))
            out = []
            for body, starts, ends in zip(column.to_pylist(), batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()):
                if starts is None:
                    out.append(body)
                    continue
                data = body.encode()
                raw = np.frombuffer(data, np.uint8)
                first, last = common.word_bounds(raw, np.zeros(0, np.int64))
                gone = np.zeros(len(first) + 1, np.int32)
                np.add.at(gone, starts, 1)
                np.add.at(gone, ends, -1)
                left = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
                if not len(left):
                    out.append("")
                    continue
                head = left[np.concatenate([[True], np.diff(left) != 1])]
                tail = left[np.concatenate([np.diff(left) != 1, [True]])]
                pieces = []
                for a, b in zip(head, tail):
                    # A passage goes with the white space before what follows it.
                    pieces.append(data[first[a] if a else 0 : first[b + 1] if b + 1 < len(first) else len(data)])
                out.append(b"".join(pieces).decode().rstrip() if tail[-1] + 1 < len(first) else b"".join(pieces).decode())
            keep = np.array([s is None or bool(x) for x, s in zip(out, batch.column(len(names)).to_pylist())], bool)
            columns = [pa.array(out, column.type) if name == text else c for name, c in zip(names, batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    key = F.xxhash64(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`"))
    known = F.col(f"`{doc_id}`").isNotNull() & F.col(f"`{text}`").isNotNull()
    joined = docs.join(cuts.hint("shuffle_hash"), F.when(known, key) == F.col(row), "left").select(*[F.col(f"`{c}`") for c in names], starts, ends)
    cut_docs = joined.mapInArrow(cut, schema)
    if length is None or length not in names:
        return cut_docs
    kind = schema[length].dataType
    return cut_docs.withColumn(length, F.when(F.col(f"`{text}`").isNull(), F.col(f"`{length}`")).otherwise(F.length(F.col(f"`{text}`"))).cast(kind))


def query(spark, sf_dir: str) -> DataFrame:
    """Every repeated passage that is cut: its document, its words from start to before end, and where it stays."""
    found = repeated_passages(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), "kept_in")


ORACLE_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\t\n\x0b\x0c\r ]+') AS words FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
passages AS (
  SELECT doc_id, unnest([md5(array_to_string(words[i + 1:i + {WORDS}], ' ')) for i in range(len(words) - {WORDS - 1})]) AS passage, unnest(range(len(words) - {WORDS - 1})) AS place
  FROM w WHERE len(words) >= {WORDS}),
firsts AS (SELECT *, first(doc_id) OVER same AS kept_in, row_number() OVER same AS n FROM passages WINDOW same AS (PARTITION BY passage ORDER BY doc_id, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
again AS (SELECT doc_id, kept_in, place, CASE WHEN place <= lag(place) OVER runs + {WORDS} THEN 0 ELSE 1 END AS new FROM firsts WHERE n > 1 WINDOW runs AS (PARTITION BY doc_id, kept_in ORDER BY place)),
marked AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, kept_in ORDER BY place ROWS UNBOUNDED PRECEDING) AS run FROM again)
SELECT doc_id, CAST(min(place) AS INTEGER) AS start_word, CAST(max(place) + {WORDS} AS INTEGER) AS end_word, kept_in FROM marked GROUP BY doc_id, kept_in, run
"""
