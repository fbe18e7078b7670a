"""Languages of documents and of their stretches, with a confidence.

Method: a bidirectional gated recurrent network over bytes (``gru``), trained in numpy, labels every
position; the labels are pooled over sentences, and those over the document.

It is trained on the driver on clean sentences and on sentences of a bounded sample of labelled rows,
whose labels may be wrong: after a first pass, sentences that the network is sure of take its label,
and others keep theirs only where the network does not object.
"""

from __future__ import annotations

import hashlib
import io
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import gru
from quillgraph.session import shared_folder

LANGUAGES = ("de", "en", "es", "fr", "it", "ja", "nl", "pt", "ru", "zh")
#: The class of text that tells no language: names, references, numbers.
NONE = len(LANGUAGES)
#: Bounds of the training data: rows of the sample, sentences of each, bytes of a sentence.
SAMPLE_ROWS, SENTENCES_EACH, SENTENCE_BYTES = 4000, 4, 160
#: Steps of training in both passes, and sentences in each.
STEPS, BATCH = (420, 420), 192
#: Confidence at which a sentence shows a second language, and one at which a document is said to have one.
SURE, ENOUGH = 0.9, 0.5

# Other spellings of the languages' labels.
LABELS = {
    "de": "de deu ger german deutsch",
    "en": "en eng english",
    "es": "es spa spanish español espanol castellano castilian",
    "fr": "fr fra fre french français francais",
    "it": "it ita italian italiano",
    "ja": "ja jpn jp japanese 日本語",
    "nl": "nl nld dut dutch nederlands flemish",
    "pt": "pt por portuguese português portugues",
    "ru": "ru rus russian русский",
    "zh": "zh zho chi cmn chinese mandarin 中文 汉语 漢語",
}
_LABEL = {spelling: code for code, spellings in LABELS.items() for spelling in spellings.split()}


def label_code(label: str | None) -> str | None:
    """The language a label names, in any spelling or regional form; None for a meaningless one."""
    if not label:
        return None
    bare = label.strip().lower()
    return _LABEL.get(bare) or _LABEL.get(re.split(r"[\s_\-(,;/]", bare, maxsplit=1)[0])


# --- sentences ----------------------------------------------------------------------------------

# A line break within a sentence: after a hyphen in a word, or beside a space that stayed.
_SOFT = re.compile(r"(?<=\w)-\r?\n(?=[^\W\d_])|\r?\n (?=\S)| \r?\n(?=\S)")
# Sentences end at closing punctuation before white space, at that of Chinese and Japanese, and at line breaks.
# One set of characters first, so that the search skips to these.
_END = re.compile(
    r"[.!?…。！？\r\n\u2028\u2029](?:(?<=[.!?…])[\"'»”’)\]]?(?=\s)|(?<=[。！？])[」』”]?|(?<=[\r\n\u2028\u2029])[\r\n\u2028\u2029]*)"
)
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
#: A word of letters alone, not part of a path, an address or an identifier.
_PLAIN = re.compile(r"(?<![\w/.:@=\-])[^\W\d_]{2,}(?:['’\-][^\W\d_]+)*(?![\w/@=]|[.:]\w)")
_WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af]{2}")
#: Sentences shorter than that join the next, unless a line ends or the mark is Chinese or Japanese.
_SHORT = 12
#: Bytes of the shortest run of another language within a sentence, and the price of a change of language.
RUN, CHANGE = 32, 8.0


def sentences(text: str) -> list[tuple[int, int]]:
    """(begin, end) of the sentences and lines of a whole text, in characters; white space is left out."""
    soft = {m.start() + m.group().index("\n") for m in _SOFT.finditer(text)} if "\n" in text else ()
    out, begin, size = [], 0, len(text)
    for m in _END.finditer(text):
        a, b = m.span()
        mark = text[a]
        line = mark in "\r\n\u2028\u2029"
        if line and soft and (a in soft or a + 1 in soft) and text.count("\n", a, b) < 2:
            continue
        if not line and mark not in "。！？" and b - begin < _SHORT and b < size:
            continue  # "J." and the like stay with what follows
        out.append((begin, a if line else b))
        begin = b
    out.append((begin, size))
    return _trimmed(text, out)


def _trimmed(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    trimmed = []
    for a, b in spans:
        piece = text[a:b]
        bare = piece.lstrip()
        if bare:
            trimmed.append((b - len(bare), a + len(piece.rstrip())))
    return trimmed


class _Reading(dict):
    """How each character is read: lower case, digits alike, odd characters not at all."""

    GONE = ("Cf", "So", "Cc", "Sk", "Co", "Cs", "Cn")

    def __missing__(self, code: int):
        c = chr(code)
        kind = unicodedata.category(c)
        self[code] = way = " " if c.isspace() else None if kind in self.GONE else "0" if kind == "Nd" else c.lower()
        return way


_READING = _Reading()


def prepared(sentence: str) -> str:
    """What the network reads: lower case, line breaks undone, digits alike, without odd characters."""
    if "\n" in sentence:
        sentence = _SOFT.sub(lambda m: "" if m.group()[0] == "-" else " ", sentence)
    s = " ".join(sentence.translate(_READING).split())
    return s if s.isascii() or unicodedata.is_normalized("NFC", s) else unicodedata.normalize("NFC", s)


def tells(sentence: str) -> int:
    """How much a sentence can tell: its words of letters alone, or its pairs of East Asian characters,
    counted up to 3. Words that touch digits, slashes and the like (paths, identifiers) do not count."""
    count = 0
    for pattern in (_PLAIN,) if sentence.isascii() else (_PLAIN, _WIDE):
        count = 0
        for _ in pattern.finditer(sentence):
            count += 1
            if count == 3:
                return 3
        if count and pattern is _PLAIN and _WIDE.search(sentence) is None:
            return count
    return count


def _place(sentence: str, size: int) -> int:
    """The place in a sentence before which the network reads about ``size`` bytes, not within a word."""
    low, high = 0, len(sentence)
    while low < high:
        middle = (low + high) // 2
        if len(prepared(sentence[:middle]).encode("utf-8", "ignore")) < size:
            low = middle + 1
        else:
            high = middle
    narrow = lambda c: c.isalnum() and not "\u3040" <= c <= "\u9fff"
    near = [i for i in range(1, len(sentence)) if abs(i - low) <= 16 and not (narrow(sentence[i - 1]) and narrow(sentence[i]))]
    return min(near, key=lambda i: abs(i - low), default=low)


# --- training -----------------------------------------------------------------------------------


def _cut_bytes(s: str, start: int = 0) -> bytes:
    return s.encode("utf-8", "ignore")[start : start + SENTENCE_BYTES]


def _picked(documents: DataFrame) -> DataFrame:
    """(lang, sentence): a few sentences of each row of the sample, the rows with the least hashes."""
    labelled = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = labelled.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, out = [], []
            for row, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                code = label_code(lang)
                found = sentences(text) if code else []
                if not found:
                    continue
                rng = np.random.default_rng(abs(hash_of(row)) % 2**32)
                for i in rng.permutation(len(found))[:SENTENCES_EACH]:
                    s = text[found[i][0] : found[i][1]]
                    if tells(s) >= 3:
                        langs.append(code)
                        out.append(s[:SENTENCE_BYTES])
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(out, pa.string())],
                names=["lang", "sentence"],
            )

    rows = labelled.join(F.broadcast(sample), "doc_id", "left_semi").select(
        F.col("doc_id").cast("string"),
        "lang",
        "text",
    )
    return rows.mapInArrow(pick, "lang string, sentence string")


def hash_of(value: str) -> int:
    """The same for a value in every process, unlike ``hash``."""
    h = 1469598103934665603
    for b in str(value).encode():
        h = ((h ^ b) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return h


def _names(texts: list[str]) -> list[str]:
    """Words written with a capital within sentences and never without one: mostly names."""
    small, capital = set(), Counter()
    for s in texts:
        words = _WORD.findall(s)
        small.update(w for w in words if w[0].islower())
        capital.update(w for w in words[1:] if w[0].isupper() and w[1:].islower() and len(w) > 3 and w.isascii())
    return sorted(w for w in capital if w.lower() not in small)


def _nothing(names: list[str], rng: np.random.Generator) -> str:
    """A line that tells no language: authors, a reference, an identifier, a path, numbers."""
    pick = lambda: names[rng.integers(len(names))] if names else "Xyz"
    kind = rng.integers(6)
    if kind < 3:
        initial = lambda: chr(65 + rng.integers(26)) + ("." if rng.random() < 0.4 else "")
        people = [
            f"{initial()} {pick()}" if rng.random() < 0.6 else f"{pick()} {initial()}" for _ in range(rng.integers(1, 6))
        ]
        return ", ".join(people)
    if kind == 3:
        return f"({pick()} {rng.integers(1900, 2030)}; {pick()} {rng.integers(1900, 2030)})"
    if kind == 4:
        return " ".join(
            f"{rng.random() * 10 ** rng.integers(1, 7):.{rng.integers(0, 4)}f}" for _ in range(rng.integers(2, 12))
        )
    return rng.choice(["doi:10.", "arXiv:", "/srv/", "https://", "id="]) + "/".join(
        str(rng.integers(10**6)) for _ in range(rng.integers(1, 5))
    ) + rng.choice([".pdf", "", "v2", ".txt"])


def _varied(s: str, rng: np.random.Generator) -> bytes:
    """The sentence as the network may meet it: without accents, begun at any byte."""
    p = prepared(s)
    if not p.isascii() and rng.random() < 0.25:
        p = "".join(c for c in unicodedata.normalize("NFD", p) if not unicodedata.combining(c))
        p = unicodedata.normalize("NFC", p)
    raw = p.encode("utf-8", "ignore")
    return raw[rng.integers(0, max(1, min(len(raw) // 3, 24))) :][:SENTENCE_BYTES] or b" "


def fit(
    clean: list[tuple[str, str]],
    labelled: list[tuple[str, str]],
    seed: int = 3,
    steps: tuple[int, int] = STEPS,
) -> gru.Network:
    """A network trained on (language, sentence) pairs: ``clean`` ones and ``labelled`` ones, whose
    labels may be wrong. The same data in any order give the same network."""
    rng = np.random.default_rng(seed)
    number = {code: i for i, code in enumerate(LANGUAGES)}
    clean = sorted((number[c], s) for c, s in clean if c in number)
    labelled = sorted((number[c], s) for c, s in labelled if c in number)
    names = _names([s for _, s in labelled])
    network = gru.Network(NONE + 1, seed)
    classes = np.eye(NONE + 1, dtype=np.float32)

    def batches(rows: list[tuple[int, str]], count: int) -> Iterator:
        if not rows:
            return
        kinds = np.array([c for c, _ in rows])
        often = np.bincount(kinds, minlength=NONE + 1).astype(float)
        weight = 1 / np.maximum(often, 1)[kinds] ** 0.6
        weight /= weight.sum()
        share = min(0.3, 4 * len(clean) / max(1, len(rows))) if clean else 0.0
        for step in range(count):
            picks = [rows[i] for i in rng.choice(len(rows), BATCH, p=weight)] if rows else []
            for i in range(len(picks)):
                chance = rng.random()
                if chance < share:
                    picks[i] = clean[rng.integers(len(clean))]
                elif chance < share + 0.08:
                    picks[i] = (NONE, _nothing(names, rng))
            x, lengths = gru.patches([_varied(s, rng) for _, s in picks])
            yield x, lengths, classes[[c for c, _ in picks]], step / count

    everything = labelled + clean
    if not everything:
        return network
    gru.train(network, batches(everything, steps[0]))
    if labelled:  # second pass: on what the first makes of the labels
        pooled = Reader(network).pooled([s for _, s in labelled])
        kept = []
        for (code, s), p in zip(labelled, pooled):
            best = int(p[:NONE].argmax())
            if p[best] > 0.7:
                kept.append((best, s))
            elif best == code:
                kept.append((code, s))
        gru.train(network, batches(kept + clean, steps[1]), rate=0.006)
    return network


# --- labelling ----------------------------------------------------------------------------------


class Reader:
    """Labels sentences. Sentences that come again, but for digits and case, are looked up."""

    #: Sentences kept, and sentences read at once.
    KEPT, AT_ONCE = 150_000, 512

    def __init__(self, network: gru.Network):
        self.network = network
        self.known: dict[str, int] = {}
        self.told = np.zeros(0, np.int8)
        self.rows = np.zeros((0, NONE + 1), np.float32)
        self.second = np.zeros(0, np.float32)

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How much each sentence tells, and its class probabilities: the mean over all its positions.
        A sentence that tells nothing is not read; its class is NONE."""
        at = self._at(texts)
        return self.told[at], self.rows[at]

    def _at(self, texts: list[str]) -> np.ndarray:
        """Where the sentences are kept; those not known are read. ``second`` has the bytes of their second language."""
        keys = list(map(prepared, texts))
        if len(self.known) > self.KEPT:
            self.__init__(self.network)
        known = self.known
        new = [k for k in dict.fromkeys(keys) if k not in known]
        if new:
            base = len(known)
            known.update(zip(new, range(base, base + len(new))))
            told = np.fromiter(map(tells, new), np.int8, len(new))
            rows = np.zeros((len(new), NONE + 1), np.float32)
            rows[told == 0, NONE] = 1
            second = np.zeros(len(new), np.float32)
            raw = {int(i): new[i].encode("utf-8", "ignore") for i in np.flatnonzero(told)}
            order = sorted(raw, key=lambda i: len(raw[i]))
            start = 0
            while start < len(order):
                # As many as fit a bounded number of positions: one very long sentence is read alone.
                longest = len(raw[order[min(start + self.AT_ONCE, len(order)) - 1]])
                part = order[start : start + max(1, min(self.AT_ONCE, 400_000 // longest))]
                x, lengths = gru.patches([raw[i] for i in part])
                p = self.network.probabilities(x, lengths)
                if lengths.min() != len(x):
                    p *= (np.arange(len(x))[:, None] < lengths)[:, :, None]
                sums = p.sum(0)
                rows[part] = sums / lengths[:, None]
                second[part] = np.partition(sums[:, :NONE], -2, axis=1)[:, -2] * gru.PATCH
                start += len(part)
            self.told, self.rows = np.concatenate([self.told, told]), np.concatenate([self.rows, rows])
            self.second = np.concatenate([self.second, second])
        return np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))

    def read_texts(self, texts: list[str | None]) -> list[tuple[list[tuple[int, int]], list[int], np.ndarray]]:
        """Of each whole text: its sentences, how much each tells, and their class probabilities. A sentence
        that changes its language comes out in parts."""
        spans = [sentences(t) if t else [] for t in texts]
        at = self._at([t[a:b] for t, s in zip(texts, spans) for a, b in s])
        told, rows, mixed = self.told[at], self.rows[at], self.second[at] >= SURE * RUN
        out, begin = [], 0
        for text, s in zip(texts, spans):
            own = slice(begin, begin + len(s))
            begin += len(s)
            if mixed[own].any():
                s = [part for span, m in zip(s, mixed[own]) for part in (self.parts(text, *span) if m else [span])]
            if len(s) == own.stop - own.start:
                out.append((s, told[own].tolist(), rows[own]))
            else:
                own_told, own_rows = self.read([text[a:b] for a, b in s])
                out.append((s, own_told.tolist(), own_rows))
        return out

    def parts(self, text: str, begin: int, end: int) -> list[tuple[int, int]]:
        """(begin, end) of the parts of a sentence that are each in one language: the likeliest labels
        of its positions where a change has a price, in runs of at least RUN bytes. It stays whole unless
        each part, read alone, is surely in another language than the one before it."""
        sentence = text[begin:end]
        p = np.log(np.maximum(self.positions(prepared(sentence))[:: gru.PATCH, :NONE], 1e-6))
        back = np.zeros(p.shape, np.int64)
        best = p[0]
        for i in range(1, len(p)):
            other = int(best.argmax())
            back[i] = np.where(best[other] - CHANGE > best, other, np.arange(NONE))
            best = np.maximum(best, best[other] - CHANGE) + p[i]
        labels = [int(best.argmax())]
        for i in range(len(p) - 1, 0, -1):
            labels.append(int(back[i, labels[-1]]))
        labels.reverse()
        starts = [0] + [i for i in range(1, len(labels)) if labels[i] != labels[i - 1]]
        runs: list[list[int]] = []
        for a, b in zip(starts, [*starts[1:], len(labels)]):
            # A short run, of a borrowed term or a name, stays with what is before it.
            if runs and ((b - a) * gru.PATCH < RUN or labels[a] == runs[-1][1]):
                continue
            runs.append([a, labels[a]])
        if len(runs) > 1 and (runs[1][0] - runs[0][0]) * gru.PATCH < RUN:
            del runs[1]
        cuts = [begin + _place(sentence, a * gru.PATCH) for a, _ in runs[1:]]
        parts = _trimmed(text, list(zip([begin, *cuts], [*cuts, end])))
        told, rows = self.read([text[a:b] for a, b in parts])
        alone = rows[:, :NONE]
        changes = (alone.argmax(1)[1:] != alone.argmax(1)[:-1]).all()
        return parts if changes and told.min() >= 3 and alone.max(1).min() >= SURE else [(begin, end)]

    def pooled(self, texts: list[str]) -> np.ndarray:
        return self.read(texts)[1]

    def positions(self, text: str) -> np.ndarray:
        """Class probabilities of every byte of a prepared sentence."""
        raw = text.encode("utf-8", "ignore") or b" "
        x, lengths = gru.patches([raw])
        return np.repeat(self.network.probabilities(x, lengths)[:, 0], gru.PATCH, axis=0)[: len(raw)]


def stretches(spans: list[tuple[int, int]], told: list[int], pooled: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(begin, end, language, confidence): stretches of one language from sentences of a text.

    A sentence belongs to the language with the highest pooled probability if it can tell one: it has
    some words, and the network is not surer that it tells none. Sentences that tell nothing join the
    stretch around them. The confidence of a stretch is the mean over its telling sentences, by length;
    a stretch of low confidence comes out as well.
    """
    out: list[list] = []
    for (a, b), words, p in zip(spans, told, pooled):
        best = int(p[:NONE].argmax())
        if words < 1 or p[NONE] > p[best]:
            continue
        least = SURE if words >= 3 else 0.97
        if out and best != out[-1][2] and p[best] < least:
            continue  # not sure enough to begin another language
        if out and out[-1][2] == best:
            out[-1][1] = b
            out[-1][3] += float(p[best]) * (b - a)
            out[-1][4] += b - a
            out[-1][5] = max(out[-1][5], float(p[best]) if words >= 3 else 0.0)
        else:
            out.append([a, b, best, float(p[best]) * (b - a), b - a, float(p[best]) if words >= 3 else 0.0])
    # A language without one sure sentence of some words is none of the text's, if it has another.
    strong = {o[2] for o in out if o[5] >= SURE}
    if strong:
        out = [o for o in out if o[2] in strong]
    merged: list[list] = []
    for o in out:
        if merged and merged[-1][2] == o[2]:
            merged[-1][1] = o[1]
            merged[-1][3] += o[3]
            merged[-1][4] += o[4]
        else:
            merged.append(o)
    return [(o[0], o[1], o[2], o[3] / o[4]) for o in merged]


_READERS: dict[int, Reader] = {}


def _reader(network: gru.Network, key: int) -> Reader:
    if key not in _READERS:
        _READERS.clear()
        _READERS[key] = Reader(network)
    return _READERS[key]


def train_on(documents: DataFrame, samples: DataFrame | None) -> gru.Network:
    """The network for a corpus. At most SAMPLE_ROWS * SENTENCES_EACH sentences reach the driver.

    A trained network is kept in the session's checkpoint folder under a hash of what it was trained on,
    so it is trained once for a corpus, whatever is asked of it and by whichever session.
    """
    clean = [
        (r.lang, r.text) for r in samples.select("lang", "text").orderBy("lang", "text").limit(SAMPLE_ROWS).collect()
    ] if samples is not None else []
    clean = [(label_code(c), s) for c, s in clean if s and label_code(c)]
    picked = [(r.lang, r.sentence) for r in _picked(documents).collect()]
    spark = documents.sparkSession
    learnt = repr((sorted(clean), sorted(picked), STEPS, BATCH, gru.PATCH, gru.UNITS)).encode("utf-8", "surrogatepass")
    place = f"{shared_folder(spark)}/language-{hashlib.sha256(learnt).hexdigest()[:32]}.npz"
    return _kept(spark, place) or _keep(spark, place, fit(clean, picked))


def _kept(spark: SparkSession, place: str) -> gru.Network | None:
    """A network that was kept, from any file system that Spark reaches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        raw = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()
    network = gru.Network(NONE + 1)
    with np.load(io.BytesIO(raw)) as stored:
        network.p = {k: stored[k] for k in network.p}
    return network


def _keep(spark: SparkSession, place: str, network: gru.Network) -> gru.Network:
    """Written beside and renamed, so that nobody reads a part; one that is there already stays."""
    out = io.BytesIO()
    np.savez(out, **network.p)
    path = spark._jvm.org.apache.hadoop.fs.Path
    part, whole = path(f"{place}.{uuid.uuid4().hex}"), path(place)
    fs = whole.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(part, False)
    stream.write(bytearray(out.getvalue()))
    stream.close()
    if fs.exists(whole) or not fs.rename(part, whole):
        fs.delete(part, False)
    return network


def label(
    documents: DataFrame,
    samples: DataFrame | None,
    network: gru.Network | None = None,
    whole: bool = False,
) -> DataFrame:
    """(doc_id, label, begin, end, lang, confidence): the stretches of every document.

    ``begin`` and ``end`` count characters of the text; ``label`` is the language that the delivered
    label names, NULL if none. A document without any (NULL, blank, nothing but numbers, names, paths)
    has one row with the last four NULL. Every row of ``documents`` comes out, repeated rows as often
    as they occur. Whole texts are read. With ``whole``, one row per document and language comes out,
    (doc_id, label, lang, confidence, chars, languages): the mean confidence by length, the characters,
    and how many languages the document has. Texts do not leave their partition: there is no shuffle.
    """
    network = network or train_on(documents, samples)
    shared = documents.sparkSession.sparkContext.broadcast(network)
    key = int(np.abs(network.p["c"]).sum() * 1e9) ^ id(shared)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(shared.value, key)
        for all_rows in batches:
            for start in range(0, all_rows.num_rows, 1000):
                batch = all_rows.slice(start, 1000)
                texts = batch.column(2).to_pylist()
                rows: list[tuple] = []
                for i, read_text in enumerate(reader.read_texts(texts)):
                    found = stretches(*read_text)
                    if whole:
                        found = _by_language(found)
                    rows += [(i, *f) for f in found] or [(i, None, None, None, None)]
                index = pa.array([r[0] for r in rows])
                codes = [label_code(v) for v in batch.column(1).to_pylist()]
                kinds = (pa.float64(), pa.int64(), pa.int32()) if whole else (pa.int32(), pa.int32(), pa.float64())
                places = (2, 3, 4) if whole else (1, 2, 4)
                lang = pa.array(
                    [None if r[1 if whole else 3] is None else LANGUAGES[r[1 if whole else 3]] for r in rows],
                    pa.string(),
                )
                values = [pa.array([r[k] for r in rows], kind) for k, kind in zip(places, kinds)]
                columns = [lang, *values] if whole else [*values[:2], lang, values[2]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(index),
                        pa.array([codes[r[0]] for r in rows], pa.string()),
                        *columns,
                    ], names=names
                )

    shape = "lang string, confidence double, chars long, languages int" if whole else "begin int, end int, lang string, confidence double"
    names = ["doc_id", "label", *(c.split()[0] for c in shape.split(", "))]
    source = documents.select("doc_id", "lang", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(read, f"doc_id {kind}, label string, {shape}")


def _by_language(found: list[tuple[int, int, int, float]]) -> list[tuple[int, float, int, int]]:
    sums: dict[int, list[float]] = {}
    for begin, end, lang, confidence in found:
        own = sums.setdefault(lang, [0.0, 0])
        own[0] += confidence * (end - begin)
        own[1] += end - begin
    return [(lang, total / chars, chars, len(sums)) for lang, (total, chars) in sums.items()]


def found(documents: DataFrame, samples: DataFrame | None) -> DataFrame:
    """(doc_id, lang): true languages of the documents whose label does not tell them."""
    each = label(documents, samples, whole=True).where(F.col("confidence") >= ENOUGH)
    return each.where(
        (F.col("languages") > 1) | F.col("label").isNull() | (F.col("label") != F.col("lang")),
    ).select("doc_id", "lang")
