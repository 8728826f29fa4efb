"""Toxicity: noisy-channel restoration of disguised words, then learned evidence in the restored text.

1. A character language model counts trigrams over all documents.
2. Words that look disguised (digits, signs or letters of other scripts among letters, letters set apart, letters drawn
   out, full-width forms) span a lattice of the letters each character may stand for; Viterbi decoding under the
   language model picks the reading.
3. Labelled texts are restored so, and every word and word beginning gets its log-odds of toxic against other texts,
   less 1.28 standard errors; what is left above zero is evidence. The trigrams of words with strong evidence then join the
   language model with OWN_SHARE of its weight, for scoring.
4. A text's strongest evidence, the sum of its words' evidence and its number of distinct tokens go through a logistic
   function, fitted on the labelled texts with evidence learned from the other half of them.

Only rows whose crc32(doc_id) mod 4 is not 2 teach labels, at most TRAIN_ROWS of them, those with the smallest hash.
Nothing but the text goes into a score. Null and empty texts score as texts without evidence. Repeated rows score
alike; of several texts under a labelled id the one with the least hash teaches; a document with several labels counts
as toxic if any of them says so. Without any toxic label every score is 0, without any other label 1. An empty table
gives no rows. Other columns, whatever their names, are not carried.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopframe.llm.common import checkpointed, table, tidied

THRESHOLD = 0.3
#: Labelled rows that teach, at most; toxic texts that an entry needs; standard errors taken off its log-odds.
TRAIN_ROWS, SUPPORT, ERRORS = 20_000, 3, 1.28
#: Weight of the words with strong evidence in the language model, as a share of the corpus's, and what is strong.
OWN_SHARE, STRONG = 0.3, 2.0
#: Lengths of the word beginnings that are entries.
BEGINNINGS = (4, 5, 6, 7)
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøœùúûüýÿß"
SIZE = len(LETTERS) + 1
_CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
#: What a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "#": "h", "%": "o", "*": "aeiou", "?": "aeiou",
}
#: Letters of other scripts that look like Latin ones.
ALIKE = dict(zip("асеіјорѕухкмнтвгԁһӏαβγεικνορτυχω", ["a", "c", "e", "i", "j", "o", "p", "s", "y", "x", "k", "m", "hn", "t", "bv", "r", "d", "h", "l", "a", "b", "y", "e", "i", "k", "nv", "o", "p", "t", "u", "x", "w"], strict=True))
READ = LEET | ALIKE
_SIGNS, _ALIKE = re.escape("".join(LEET)), "".join(ALIKE)
_L = "a-zß-öø-ÿœ"
_WORD = re.compile(f"[{_L}]+")
#: Letters or signs set apart by a star or up to three other separators (taken whole, so that no run of them can be
#: parted in more than one way); signs or foreign letters among letters; a letter drawn out.
_BETWEEN = r"(?:\*|[ ._\-~'/,]{1,3}+)"
_APART = re.compile(rf"(?<![{_L}{_SIGNS}])(?:[{_L}{_SIGNS}]{_BETWEEN}){{2,}}[{_L}{_SIGNS}](?![{_L}{_SIGNS}])")
_SPACED = re.compile(rf"(.)(?:{_BETWEEN}|\Z)", re.S)
_MIXED = re.compile(rf"[{_L}][{_SIGNS}._\-~^'/]+[{_L}]|[{_SIGNS}][{_L}]|[{_L}]{{2}}[013457@$](?![{_SIGNS}])|[{_L}][@$]{{2}}(?![{_SIGNS}])|[{_L}][{_ALIKE}]|[{_ALIKE}][{_L}]|([{_L}])\1\1")
_DRAWN = re.compile(r"(.)\1\1")
_ENDS = ".,;:\"'()[]"
#: Invisible characters go, full-width forms become the plain ones.
_FOLDED = re.compile("[\xad\u200b-\u200d\u2060\ufeff\uff01-\uff5e]")
_FOLD = dict.fromkeys(map(ord, "\xad\u200b\u200c\u200d\u2060\ufeff")) | {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
#: Log costs: a sign read as a letter; a separator, a star or another sign passed over; a run shortened.
_READ, _ONCE, _HALVED = math.log(0.3), math.log(0.5), math.log(0.05)
_PASS = {"*": math.log(0.05)} | {c: math.log(0.0005) for c in LEET if c not in "*%#?"} | dict.fromkeys(ALIKE, math.log(0.0005))
#: Tokens whose evidence a worker keeps, and the longest of them.
_KEPT, _KEPT_CHARS = 300_000, 40


def trigram_index(text: str):
    """The trigram of every character of a text that is a letter or ends a word."""
    import numpy as np

    codes = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    table_ = np.zeros(0x180, np.int32)
    for c, i in _CODE.items():
        table_[ord(c)] = i
    x = np.zeros(len(codes) + 3, np.int32)
    x[2:-1] = table_[np.minimum(codes, 0x17F)]
    keep = (x[2:] > 0) | (x[1:-1] > 0)
    return ((x[:-2] * SIZE + x[1:-1]) * SIZE + x[2:])[keep]


def language_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """cell, n: how often each letter trigram occurs over all texts; at most SIZE cubed rows."""

    def count(batches):
        import numpy as np

        total = np.zeros(SIZE**3, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                # two line ends between texts: no trigram reaches from one into the next
                joined = "\n\n".join(t or "" for t in b.column(0).slice(at, 500).to_pylist())
                total += np.bincount(trigram_index(joined), minlength=SIZE**3)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    return texts.select(text).mapInArrow(tidied(count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def collected(counts: DataFrame) -> dict[int, int]:
    return {r["cell"]: r["n"] for r in counts.collect()}


class Restorer:
    """Viterbi decoding of disguised words under a character trigram model.

    counts: trigrams of the corpus; own: trigrams that get OWN_SHARE of the corpus's weight, so that rare words with
    evidence can be read at all.
    """

    def __init__(self, counts: dict[int, int], own: dict[int, int] | None = None):
        import numpy as np

        total = np.full(SIZE**3, 0.01)
        for k, n in counts.items():
            total[k] += n
        weight = OWN_SHARE * total.sum() / max(1, sum((own or {}).values()))
        for k, n in (own or {}).items():
            total[k] += weight * n
        cube = total.reshape(SIZE, SIZE, SIZE)
        self.log = np.log(cube / cube.sum(axis=2, keepdims=True)).tolist()
        self.cache: dict[str, str] = {}

    @staticmethod
    def lattice(token: str) -> list[list[tuple[str, float]]]:
        """For each run of one character the readings it has and the log of each one's likelihood."""
        out = []
        for m in re.finditer(r"(.)\1*", token, re.S):
            ch, n = m[1], len(m[0])
            options: list[tuple[str, float]] = []
            for read, cost in [(ch, 0.0)] if ch in _CODE else [(x, _READ) for x in READ.get(ch, "")]:
                if n == 1:
                    options.append((read, cost))
                else:  # drawn out: once or twice
                    options += [(read, cost + (_HALVED if n == 2 else _ONCE)), (read * 2, cost + (0.0 if n == 2 else _ONCE))]
            if ch not in _CODE:
                options.append(("", _PASS.get(ch, 0.0)))
            out.append(options)
        return out

    def decode(self, token: str) -> str:
        """The likeliest letters behind a token."""
        if token in self.cache:
            return self.cache[token]
        log = self.log
        # state: the last two letters; value: score and the readings so far, as a chain
        beam: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in self.lattice(token):
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in beam.items():
                for read, cost in options:
                    s, x, y = score + cost, a, b
                    for c in read:
                        z = _CODE[c]
                        s, x, y = s + log[x][y][z], y, z
                    if (x, y) not in new or new[x, y][0] < s:
                        new[x, y] = (s, (path, read) if read else path)
            beam = new
        path, parts = max(((s + log[a][b][0], p) for (a, b), (s, p) in beam.items()), key=lambda x: x[0])[1], []
        while path is not None:
            path, read = path
            parts.append(read)
        best = "".join(reversed(parts))
        if len(token) <= _KEPT_CHARS:
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[token] = best
        return best

    def token_words(self, token: str) -> list[str]:
        """The plain and restored words in a token of a lower-case text without white space."""
        core = token.strip(_ENDS)
        if core.isascii() and core.isalpha() and not _DRAWN.search(core):
            return [core]
        found = _WORD.findall(token)
        if _MIXED.search(core):
            found.append(self.decode(core))
        return found

    def apart(self, text: str) -> set[str]:
        """What letters set apart in a lower-case text spell."""
        return {self.decode(m) for m in {"".join(_SPACED.findall(m[0])) for m in _APART.finditer(text)}}

    def parts(self, text: str | None) -> tuple[set[str], set[str], int]:
        """The plain and restored words in the tokens of a text, what its letters set apart spell, and its number of
        distinct tokens."""
        text = folded(text)
        tokens = set(text.split())
        return {w for token in tokens for w in self.token_words(token) if w}, self.apart(text), len(tokens)

    def words(self, text: str | None) -> set[str]:
        """All plain and restored words of a text."""
        words, apart, _ = self.parts(text)
        return words | apart


def folded(text: str | None) -> str:
    """A text in lower case, without invisible characters and full-width forms."""
    text = text or ""
    return (text if text.isascii() or not _FOLDED.search(text) else text.translate(_FOLD)).lower()


def entries(word: str) -> list[str]:
    """The word and its beginnings, as entries."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def evidence_of(word: str, lexicon: dict[str, float]) -> float:
    """The strongest evidence among a word's entries."""
    best = lexicon.get(word, 0.0)
    for n in BEGINNINGS:
        if len(word) <= n:
            break
        best = max(best, lexicon.get(word[:n] + "*", 0.0))
    return best


def inside(letters: str, lexicon: dict[str, float]):
    """Whole words of the lexicon within a chain of letters, of which nobody knows where its words part."""
    for start in range(len(letters)):
        for end in range(start + 4, min(len(letters), start + 24) + 1):
            if (e := lexicon.get(letters[start:end])) is not None:
                yield letters[start:end], e


def apart_evidence(apart: set[str], lexicon: dict[str, float]) -> dict[str, float]:
    """Evidence in what letters set apart spell: as words, and of words within."""
    return {w: e for w in apart if (e := evidence_of(w, lexicon))} | {w: e for x in apart for w, e in inside(x, lexicon)}


def text_evidence(words: set[str], apart: set[str], lexicon: dict[str, float]) -> dict[str, float]:
    """The words of a text that hold evidence; the same for texts that teach and texts that are scored."""
    return {w: e for w in words if (e := evidence_of(w, lexicon))} | apart_evidence(apart, lexicon)


def summary(evidence, tokens: int) -> tuple[float, float, float]:
    """Strongest evidence, log of all evidence, log of the number of distinct tokens."""
    return max(evidence, default=0.0), math.log1p(math.fsum(evidence)), math.log1p(tokens)


def _shrunk(t: Column, n: Column, toxic: float, all_: float) -> Column:
    """Log-odds of an entry in toxic against other texts, less some standard errors; 0 for little support."""
    c = n - t
    odds = F.log((t + 0.5) / (toxic - t + 0.5)) - F.log((c + 0.5) / (all_ - toxic - c + 0.5))
    error = F.sqrt(1 / (t + 0.5) + 1 / (toxic - t + 0.5) + 1 / (c + 0.5) + 1 / (all_ - toxic - c + 0.5))
    return F.when(t >= SUPPORT, F.greatest(odds - ERRORS * error, F.lit(0.0))).otherwise(F.lit(0.0))


def fitted(rows: list[tuple[float, ...]], toxic: list[int]) -> list[float]:
    """Weights of a logistic function (the constant last), by Newton's method with a little shrinkage."""
    import numpy as np

    x = np.hstack([np.array(rows, float), np.ones((len(rows), 1))])
    y, w = np.array(toxic, float), np.zeros(x.shape[1])
    keep = np.diag([1e-3 * len(rows)] * (x.shape[1] - 1) + [1e-9])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep + 1e-9 * np.eye(len(w)), x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


class Model:
    """What scoring needs: the corpus's trigrams, those of words with evidence, the evidence, the logistic weights."""

    def __init__(self, counts: dict[int, int], own: dict[int, int], lexicon: dict[str, float], weights: list[float] | None, prior: float):
        self.counts, self.own, self.lexicon, self.weights, self.prior = counts, own, lexicon, weights, prior

    def score(self, evidence, tokens: int) -> float:
        if self.weights is None:
            return self.prior
        z = sum(a * b for a, b in zip(self.weights, (*summary(evidence, tokens), 1.0), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    counts = collected(language_counts(docs))
    train = labels.filter(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    train = train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most TRAIN_ROWS rows
    taught = docs.select("doc_id", "text").join(F.broadcast(train), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "toxic")).alias("_t"))
    taught = taught.select(F.col("_t.text").alias("text"), (F.col("_t.toxic") == 1).cast("int").alias("toxic"), F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half"))
    sc = docs.sparkSession.sparkContext
    model = sc.broadcast(counts)  # SIZE cubed counts at most

    def restored(batches):
        restore = Restorer(model.value)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = [restore.parts(t) for t in part.column(0).to_pylist()]
                lists = [pa.array([sorted(f[k]) for f in found], pa.list_(pa.string())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([f[2] for f in found], pa.int32()), part.column(1), part.column(2)], names)

    names, schema = ["words", "apart", "tokens", "toxic", "half"], "words array<string>, apart array<string>, tokens int, toxic int, half int"
    taught = checkpointed(taught.repartition(4 * sc.defaultParallelism).mapInArrow(tidied(restored), schema))
    totals = {r["half"]: (r["t"], r["n"]) for r in taught.groupBy("half").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).collect()}
    (t0, n0), (t1, n1) = totals.get(0, (0, 0)), totals.get(1, (0, 0))
    if not 0 < t0 + t1 < n0 + n1:
        return Model(counts, {}, {}, None, 1.0 if t0 + t1 else 0.0)

    def listed(batches):
        for b in batches:
            both = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            entry = [list({e for w in {*words, *apart} for e in entries(w)}) for words, apart in both]
            yield pa.RecordBatch.from_arrays([pa.array(entry, pa.list_(pa.string())), b.column(3), b.column(4)], ["entries", "toxic", "half"])

    held = taught.mapInArrow(tidied(listed), "entries array<string>, toxic int, half int").select(F.explode("entries").alias("entry"), "toxic", "half")
    in_half = lambda c, h: F.sum(F.when(F.col("half") == h, c).otherwise(F.lit(0)))
    found = held.groupBy("entry").agg(in_half(F.col("toxic"), 0).alias("ta"), in_half(F.lit(1), 0).alias("na"), in_half(F.col("toxic"), 1).alias("tb"), in_half(F.lit(1), 1).alias("nb"))
    ta, na, tb, nb = (F.col(c) for c in ("ta", "na", "tb", "nb"))
    found = found.select("entry", _shrunk(ta + tb, na + nb, t0 + t1, n0 + n1).alias("all"), _shrunk(ta, na, t0, n0).alias("a"), _shrunk(tb, nb, t1, n1).alias("b"))
    # entries that stand out in at most TRAIN_ROWS texts
    rows_ = found.filter("all > 0 OR a > 0 OR b > 0").collect()
    lexicon, halves = {r["entry"]: r["all"] for r in rows_ if r["all"] > 0}, [{r["entry"]: r[c] for r in rows_ if r[c] > 0} for c in ("b", "a")]
    learned = sc.broadcast((lexicon, halves))

    def summed(batches):
        lexicon, halves = learned.value
        for b in batches:
            out, hot = [], []
            for words, apart, tokens, half in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                out.append(summary(text_evidence(words, apart, halves[half]).values(), tokens))
                hot.append("\n".join(sorted(w for w in {*words, *apart} if evidence_of(w, lexicon) >= STRONG)))
            yield pa.RecordBatch.from_arrays([*(pa.array([o[k] for o in out], pa.float64()) for k in range(3)), b.column(3), pa.array(hot, pa.string())], ["x", "y", "z", "toxic", "hot"])

    taught = checkpointed(taught.mapInArrow(tidied(summed), "x double, y double, z double, toxic int, hot string"))
    rows_ = taught.select("x", "y", "z", "toxic").collect()  # four numbers for each of at most TRAIN_ROWS texts
    weights = fitted([(r["x"], r["y"], r["z"]) for r in rows_], [r["toxic"] for r in rows_])
    return Model(counts, collected(language_counts(taught, "hot")), lexicon, weights, (t0 + t1) / (n0 + n1))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE cubed counts and the entries of learn()

    def run(batches):
        model = shared.value
        restore, lexicon = Restorer(model.counts, model.own), model.lexicon
        hot: dict[str, tuple] = {}  # tokens with evidence and the words that hold it
        cold: set[str] = set()  # tokens without

        def evidence(words):
            return tuple((w, e) for w in words if (e := evidence_of(w, lexicon)))

        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part, out = b.slice(at, 1000), []
                if len(cold) + len(hot) > _KEPT:
                    cold.clear()
                    hot.clear()
                for text in part.column(1).to_pylist():
                    text = folded(text)
                    tokens = set(text.split())
                    hits: dict[str, float] = {}
                    for token in tokens - cold:
                        found = hot.get(token)
                        if found is None:
                            found = evidence(restore.token_words(token))
                            if len(token) <= _KEPT_CHARS:
                                if found:
                                    hot[token] = found
                                else:
                                    cold.add(token)
                        if found:
                            hits.update(found)
                    apart = restore.apart(text)
                    if apart:
                        hits |= apart_evidence(apart, lexicon)
                    out.append(model.score(hits.values(), len(tokens)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(out, pa.float64()), pa.array([int(x >= THRESHOLD) for x in out], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    return rows.mapInArrow(tidied(run), "doc_id long, held_out boolean, score double, predicted int")



def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
