"""SentencePiece (BPE) encoding and decoding with a merge-type prefix table.

For every prefix of a text the last token of its encoding is unique. Walking the text once, an Aho-Corasick automaton
names the vocabulary pieces that end at each position; the one that may follow the last token of the prefix before it
(the pair is its own encoding) is stored, and the ids are read backwards from the end. Texts are cut beforehand where no
piece can cross: before a run of spaces, and around characters that stand in no longer piece; short segments recur and
are remembered per Python worker, in a memory of bounded size.

Pieces that are runs of the space mark share one score and are therefore merged last, leftmost first; their tokens depend
on the run's length only and are found by carrying out those merges.

Defined cases: a null text is empty; empty texts have no tokens; characters without a piece become byte tokens; very
long texts and segments cost time in proportion to their length; rows are independent of each other.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "▁"
#: Segments up to this length are remembered with their ids: per worker the newest so many and those used since, in two
#: generations (some 50 MB), and so many pairs of tokens (some 30 MB).
SHORT, REMEMBERED, PAIRS = 48, 120_000, 180_000


def vocabulary(path: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id, read through the library; the size is that of the vocabulary, never of the data."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)

    def kind(i: int) -> str:
        return "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "piece"

    return [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())]


class PrefixTable:
    """Encoder over a vocabulary whose pieces (but for runs of the space mark) have distinct scores."""

    def __init__(self, vocab: list[tuple[str, float, str]]):
        import ahocorasick

        pieces = [(p, s, i) for i, (p, s, kind) in enumerate(vocab) if kind == "piece"]
        self.ids = {p: i for p, _, i in pieces}
        self.score = {p: s for p, s, _ in pieces}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(vocab) if kind == "byte"}
        self.surface = [p if kind == "piece" else "" for p, _, kind in vocab]
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.plain = {p for p in self.ids if len(p) > 1 and p.strip(SPACE)}
        if len({self.score[p] for p in self.plain}) < len(self.plain):
            raise ValueError("pieces with equal scores")
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces with an inner space mark")
        joint = sorted(set("".join(self.plain)) - {SPACE})
        inner = "".join(map(re.escape, joint))
        # a run of space marks with what follows, or one character that stands in no longer piece
        self.cut = re.compile(f"{SPACE}*[{inner}]+|{SPACE}+|[^{SPACE}{inner}]").findall
        # what each piece is merged from last: the split that plain merging arrives at
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.runs: dict[int, list[str]] = {}
        self.automaton = ahocorasick.Automaton()
        reachable = [p for p in sorted(self.plain, key=lambda p: (-self.score[p], p)) if self._merged(p)]
        for p in {*reachable, *joint, SPACE}:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()

    def _merged(self, piece: str) -> bool:
        """Whether merging the piece's characters gives the piece; remembers its last two parts."""
        parts, last = list(piece), None
        while len(parts) > 1:
            found = [(-self.score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.plain]
            if not found:
                return False
            i = min(found)[1]
            last = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        self.halves[piece] = last
        return True

    def follows(self, left: str, right: str) -> bool:
        """Whether the two tokens side by side are their own encoding: no merge across their border comes before
        either of them is complete. Both are taken apart, latest merge first, until nothing is left to undo."""
        known = self.fits.get((left, right))
        if known is not None:
            return known
        a, b, limit = left, right, float("-inf")
        half, score, plain = self.halves.get, self.score, self.plain
        while True:
            joined = a + b
            # the border merge would have come before the merge that built what stands here
            if joined in plain and score[joined] > limit:
                good = False
                break
            ha, hb = half(a), half(b)
            if ha is None and hb is None:
                good = True
                break
            # undo the merge that came last; of two equal ones (both sides the same piece) the right one came last
            if hb is None or (ha is not None and score[a] < score[b]):
                limit, a = score[a], ha[1]
                strict_left = True
            else:
                limit, b = score[b], hb[0]
                strict_left = False
            # a border merge of the same score as an undone one is the same piece again: it wins where it stands further left
            if a + b in plain and score[a + b] == limit and not strict_left:
                good = False
                break
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        self.fits[left, right] = good
        return good

    def _run(self, n: int) -> list[str]:
        """Tokens of n space marks: merges of equal score, leftmost first."""
        if n not in self.runs:
            size, nxt, prev = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
            heap = [(-self.score[SPACE * 2], i, 1, 1) for i in range(n - 1)] if SPACE * 2 in self.ids else []
            while heap:
                _, i, a, b = heapq.heappop(heap)
                j = nxt[i]
                if size[i] != a or j >= n or size[j] != b:
                    continue
                size[i], size[j], nxt[i] = a + b, 0, nxt[j]
                if nxt[j] < n:
                    prev[nxt[j]] = i
                for x in (prev[i], i):
                    y = nxt[x] if x >= 0 else n
                    if x >= 0 and y < n and SPACE * (size[x] + size[y]) in self.ids:
                        heapq.heappush(heap, (-self.score[SPACE * (size[x] + size[y])], x, size[x], size[y]))
            found = [SPACE * s for s in size if s]
            if n > 4096:
                return found
            self.runs[n] = found
        return self.runs[n]

    def tokens(self, segment: str) -> list[str]:
        """Tokens of one segment, as strings; characters without a piece stand for themselves."""
        n = len(segment)
        last: list[str] = [""] * n
        follows, ends = self.follows, {}
        at = -1
        for end, piece in self.automaton.iter(segment):
            if end != at:
                # iter() gives the matches of one end together, longest first
                while at + 1 < end:  # characters that the automaton does not know
                    at += 1
                    if not last[at]:
                        last[at] = segment[at]
                at = end
            if not last[end]:
                begin = end - len(piece)
                if begin < 0 or follows(last[begin], piece):
                    last[end] = piece
        out, end = [], n - 1
        while end >= 0:
            piece = last[end] or segment[end]
            out.append(piece)
            end -= len(piece)
        out.reverse()
        if SPACE * 2 in segment:
            merged, k = [], 0
            while k < len(out):
                m = k
                while m < len(out) and out[m] == SPACE:
                    m += 1
                merged += self._run(m - k) if m > k else [out[k]]
                k = max(m, k + 1)
            out = merged
        return out

    def encode_segment(self, segment: str) -> list[int]:
        ids: list[int] = []
        for t in self.tokens(segment):
            i = self.ids.get(t)
            if i is not None:
                ids.append(i)
            else:
                ids += [self.bytes[b] for b in t.encode("utf-8", "replace")]
        return ids

    def segments(self, text: str) -> list[str]:
        return self.cut(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for s in self.segments(text) for i in self.encode_segment(s)]

    def decode(self, ids: list[int]) -> str:
        """The text: pieces joined, byte tokens read as UTF-8, space marks as spaces, less the one put in front."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.surface[i].replace(SPACE, " "))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out)
        return text[1:] if ids and self.surface[ids[0]].startswith(SPACE) else text


def model_vocabulary(spark: SparkSession, path: str | None):
    import public_tokenizers

    return spark.sparkContext.broadcast(vocabulary(path or public_tokenizers.path("piece_bpe_32k.model")))


class Memory:
    """Ids of segments, as text. When the younger generation is full it becomes the older one, which is forgotten; what is
    asked for again moves to the younger. Segments that do not decode to themselves are kept apart, with what they give."""

    def __init__(self, coder: PrefixTable):
        self.coder = coder
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.odd: dict[str, str] = {}

    def ids(self, segment: str) -> str:
        """Ids of a segment that the younger generation does not hold."""
        found = self.old.get(segment)
        if found is None:
            coder = self.coder
            known = [coder.ids.get(t) for t in coder.tokens(segment)]
            if None not in known:  # pieces join to the segment again
                found, text = ",".join(map(str, known)), segment.replace(SPACE, " ")
            else:
                ids = coder.encode_segment(segment)
                found = ",".join(map(str, ids))
                # byte tokens never cross a segment, so segments decode one by one; the leading mark is put back for decode()
                text = coder.decode([coder.ids[SPACE], *ids])
            if text != segment.replace(SPACE, " "):
                if len(self.odd) >= REMEMBERED or len(segment) > SHORT:
                    self.odd.clear()
                self.odd[segment] = text
                return found  # looked at again each time, so that its text is at hand
        if len(segment) <= SHORT:
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[segment] = found
        return found


_TABLES: dict[int, tuple[PrefixTable, Memory]] = {}


def table_of(vocab) -> tuple[PrefixTable, Memory]:
    """The worker's own prefix table and memory of segments for a broadcast vocabulary."""
    key = hash(tuple(vocab.value))
    if key not in _TABLES:
        _TABLES.clear()  # one vocabulary at a time
        coder = PrefixTable(vocab.value)
        _TABLES[key] = coder, Memory(coder)
    return _TABLES[key]


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>: the general form."""
    vocab = model_vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, _ = table_of(vocab)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [coder.encode(t or "") for t in pdf["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    vocab = model_vocabulary(encoded.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, _ = table_of(vocab)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [coder.decode(list(map(int, x))) for x in pdf["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def op6_sentencepiece(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of ids and decoded text, without keeping either: each segment is remembered with its ids."""
    vocab = model_vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, memory = table_of(vocab)
        sha = hashlib.sha256
        for pdf in batches:
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for text in pdf["text"]:
                segments = coder.segments(text or "")
                young, more = memory.young, memory.ids
                ids, odd = [], {}
                for s in segments:
                    found = young.get(s)
                    if found is None:
                        found = more(s)
                        young = memory.young
                        if s in memory.odd:
                            odd[s] = memory.odd[s]
                    ids.append(found)
                joined = ",".join(ids)
                plain = [odd.get(s) or s.replace(SPACE, " ") for s in segments] if odd else segments
                out["n_tokens"].append(joined.count(",") + 1 if joined else 0)
                out["ids_sha256"].append(sha(joined.encode()).hexdigest())
                out["decoded_sha256"].append(sha("".join(plain).replace(SPACE, " ")[1:].encode()).hexdigest())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], **out})

    return docs.select("doc_id", F.col("text")).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
