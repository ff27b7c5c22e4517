"""Languages of documents and of the segments of mixed ones.

Method: hyperdimensional profiles. Every letter has a random vector of +1 and -1; an
n-gram is the product of its letters' vectors, each permuted by its place; a text is the
sum of its n-grams; languages are the sums over labelled sentences; texts and languages
are compared by cosine. As the comparison is linear in the n-grams, the products of every
possible trigram with every language are laid into a table once and looked up afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import spread

LANGS = ["en", "tr", "de", "fr", "es", "pt", "it", "nl", "ru"]
# Other names of the languages in labels (lower case).
NAMES = {
    "en": ["eng", "english"], "tr": ["tur", "turkish", "türkçe"], "de": ["deu", "ger", "german", "deutsch"], "fr": ["fra", "fre", "french", "français"], "es": ["spa", "spanish", "español"],
    "pt": ["por", "portuguese", "português"], "it": ["ita", "italian", "italiano"], "nl": ["nld", "dut", "dutch", "nederlands"], "ru": ["rus", "russian", "русский"],
}
NO_LABEL = ["", "und", "unknown", "n/a", "na", "none", "null", "?", "??", "???", "-", "mul", "mis"]
LETTERS = " abcdefghijklmnopqrstuvwxyz" + "ßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœğışij" [:-2] + "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
K = 96
DIM = 2048


def label_code(c: Column) -> Column:
    """ISO code of a label in any of its notations, 'zxx' for no prose, null for a missing one; other labels keep their text."""
    t = F.lower(F.trim(c))
    t = F.when(t.rlike("^[a-z]{2,3}[-_].*"), F.split(t, "[-_]")[0]).otherwise(t)
    out = F.when(t.isNull() | t.isin(*NO_LABEL), None)
    for code, names in NAMES.items():
        out = out.when(t.isin(code, *names), code)
    return out.otherwise(t)


QUOTED = re.compile(r"“([^”\n]*)”|„([^“”\n]*)[“”]|«([^»\n]*)»|\"([^\"\n]*)\"")
END = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s|$)")
TOKEN = re.compile(r"(?<!\S)[^\s\d_/=\\@#$|<>{}\[\]]*[\d_/=\\@#$|<>{}\[\]]\S*")
WORD = re.compile(r"[^\W\d_]+")
CODE = np.full(0x10000, K - 1, np.int32)  # other letters share one code
for _i, _c in enumerate(LETTERS):
    CODE[ord(_c)] = _i
for _x in range(0x10000):
    if not chr(_x).isalpha():
        CODE[_x] = 0
for _c in "\u0300\u0301\u0302\u0303\u0308\u0327\u0306":
    CODE[ord(_c)] = K - 1


def unquote(text: str) -> str:
    """The text without quoted phrases of less than a sentence; positions are kept by blanks."""

    def one(m: re.Match) -> str:
        inner = next(g for g in m.groups() if g is not None)
        whole = END.search(inner) and len(WORD.findall(inner)) >= 3
        return " " + inner + " " * (len(m[0]) - len(inner) - 1) if whole else " " * len(m[0])

    return QUOTED.sub(one, text)


def sentences(text: str | None, least_words: int = 3) -> list[tuple[int, int]]:
    """(start, end) of each full sentence: prose with an end mark and enough words; log lines and code have none."""
    if not text:
        return []
    out, base = [], 0
    for line in unquote(text).split("\n"):
        at = 0
        for m in END.finditer(line):
            part = TOKEN.sub(" ", line[at : m.end()])
            if len(WORD.findall(part)) >= least_words:
                out.append((base + at, base + m.end()))
            at = m.end()
        base += len(line) + 1
    return out


def clean(text: str) -> str:
    """Lower-case prose without identifiers and numbers."""
    return TOKEN.sub(" ", text.replace("İ", "i").lower())


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the trigrams of all texts, one text after the other, and their number in each text.

    Runs of other characters count as one blank; trigrams around a blank in the middle are left out.
    """
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    c = CODE[np.minimum(raw, 0xFFFF)]
    owner = np.repeat(np.arange(len(texts)), sizes)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    c, owner = np.concatenate([[0], c[keep]]), np.concatenate([[0], owner[keep]])
    mid = np.flatnonzero(c[1:-1]) + 1
    return (c[mid - 1] * K + c[mid]) * K + c[mid + 1], np.bincount(owner[mid], minlength=len(texts))


def segment_sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of n[i] rows; empty runs give 0."""
    total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(n)
    return total[ends] - total[ends - n]


class Space:
    """Random letter vectors; the table of products of all trigrams with given language vectors."""

    def __init__(self, dim: int = DIM, seed: int = 42) -> None:
        rng = np.random.default_rng(seed)
        base = rng.choice(np.array([-1, 1], np.int8), (K, dim)).astype(np.float32)
        self.places = [np.roll(base, s, axis=1) for s in (2, 1, 0)]
        self.dim = dim

    def table(self, languages: np.ndarray) -> np.ndarray:
        """(K^3, languages): cosine share of each trigram with each language vector."""
        unit = (languages / np.linalg.norm(languages, axis=1, keepdims=True)).astype(np.float32)
        out = np.empty((K, K, K, len(unit)), np.float32)
        for a in range(K):
            left = self.places[0][a] * unit
            for lang, v in enumerate(left):
                out[a, :, :, lang] = (self.places[1] * v) @ self.places[2].T
        return out.reshape(K**3, len(unit)) / np.float32(np.sqrt(self.dim))


def scores(table: np.ndarray, texts: list[str]) -> np.ndarray:
    """Cosines of the texts with the languages. Norms take n-gram vectors as orthogonal, which they nearly are."""
    if not texts:
        return np.zeros((0, table.shape[1]), np.float32)
    out = []
    for i in range(0, len(texts), 4096):
        g, n = trigrams(texts[i : i + 4096])
        out.append(segment_sums(table[g], n) / np.sqrt(np.maximum(n, 1))[:, None])
    return np.concatenate(out)


def train(labelled: pd.DataFrame, epochs: int = 30, margin: float = 0.2, sure: float = 0.1, dim: int = DIM) -> np.ndarray:
    """The look-up table trained on labelled documents (columns text, code), some of them labelled wrongly.

    Language vectors are first bundled from all sentences with their document's label. Each document then takes
    the language nearest to it as a whole; of its sentences those clearly nearer (by `sure`) to another language
    take that one, doubtful ones are left out, and the vectors are bundled anew. Last, vectors move towards
    sentences that they hold by less than `margin`.
    """
    texts, docs, labels = [], [], []
    for d, (text, code) in enumerate(zip(labelled["text"], labelled["code"], strict=True)):
        for a, b in sentences(text):
            texts.append(clean(text[a:b]))
            docs.append(d)
            labels.append(LANGS.index(code))
    space = Space(dim)
    if not texts:
        return space.table(np.ones((len(LANGS), dim)))
    docs, y = np.array(docs), np.array(labels)
    same = np.unique(np.array(texts), return_inverse=True)[1]
    g, n = trigrams(texts)
    which, ends = np.repeat(np.arange(len(texts)), n), np.cumsum(n)
    ids, g = np.unique(g, return_inverse=True)
    vec = space.places[0][ids // (K * K)] * space.places[1][ids // K % K] * space.places[2][ids % K]

    def bundles(weight: np.ndarray) -> np.ndarray:
        """Sums of unit sentence vectors by language; weight: (sentences, languages)."""
        unit = 1 / np.sqrt(np.maximum(n, 1))
        return np.array([np.bincount(g, weights=(weight[:, k] * unit)[which], minlength=len(ids)).astype(np.float32) @ vec for k in range(weight.shape[1])])

    def cosines(v: np.ndarray) -> np.ndarray:
        unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        return segment_sums((vec @ unit.T.astype(np.float32))[g], n) / np.sqrt(np.maximum(n, 1) * dim)[:, None]

    def centred(v: np.ndarray) -> np.ndarray:
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        return v - v.mean(axis=0)

    hot, at = np.eye(len(LANGS)), np.arange(len(y))
    v = centred(bundles(hot[y]))
    for _ in range(3):
        s = cosines(v)
        whole = np.zeros((docs.max() + 1, len(LANGS)))
        np.add.at(whole, docs, s)
        home, own = whole.argmax(axis=1)[docs], s.argmax(axis=1)
        lead = s[at, own] - s[at, home]
        y = np.where(lead > sure, own, home)
        use = (lead <= 0) | (lead > sure)
        votes = np.zeros((same.max() + 1, len(LANGS)))
        np.add.at(votes, (same, home), 1)
        clear = ((votes.sum(axis=1) >= 3) & (votes.max(axis=1) > 0.6 * votes.sum(axis=1)))[same]
        y, use = np.where(clear, votes.argmax(axis=1)[same], y), use | clear
        v = centred(bundles(hot[y] * use[:, None]))
    # equal sentences of one language are kept once, with their number, from here on
    _, first, times = np.unique(same[use] * len(LANGS) + y[use], return_index=True, return_counts=True)
    pick = np.flatnonzero(use)[first]
    g, n, y = np.concatenate([g[ends[k] - n[k] : ends[k]] for k in pick]), n[pick], y[pick]
    which, at = np.repeat(np.arange(len(y)), n), np.arange(len(y))
    for _ in range(epochs):
        s = cosines(v)
        rival = np.where(hot[y] > 0, -np.inf, s).argmax(axis=1)
        loose = s[at, y] - s[at, rival] < margin
        if not loose.any():
            break
        step = bundles((hot[y] - hot[rival]) * (loose * times)[:, None])
        v = v + 0.2 * step / max(1e-9, np.linalg.norm(step, axis=1).max()) * np.linalg.norm(v, axis=1).mean()
    return space.table(v)


@dataclass(frozen=True)
class Limits:
    """train_docs: at most about so many labelled documents per language are fitted (chosen by hash).
    switch: cosine margin that a sentence needs to leave the language of its surroundings."""

    train_docs: int = 120
    switch: float = 0.08


def fit(documents: DataFrame, limits: Limits = Limits()) -> np.ndarray:
    """Fit the table on a bounded hash sample of documents with a readable label; fewer languages than LANGS are no error."""
    coded = documents.select("doc_id", "text", label_code(F.col("lang")).alias("code")).where(F.col("code").isin(*LANGS) & (F.length("text") > 0))
    n = {r[0]: r[1] for r in coded.groupBy("code").count().collect()}
    rate = F.lit(0.0)
    for code, k in n.items():
        rate = F.when(F.col("code") == code, min(1.0, 1.5 * limits.train_docs / k)).otherwise(rate)
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    w = Window.partitionBy("code").orderBy("u", "doc_id")
    few = coded.withColumn("u", u).where(F.col("u") < rate).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limits.train_docs)
    return train(few.select("text", "code").toPandas())


SEGMENTS = "doc_id long, label string, seg_no int, start int, end int, n_sentences int, lang string, confidence double"


def stretches(at: list[tuple[int, int]], s: np.ndarray, limits: Limits = Limits()) -> list[tuple[int, int, int, str, float]]:
    """(start, end, sentences, language, confidence) of each stretch of one language, from the sentences' places and cosines."""
    if not at:
        return []
    main = int(s.sum(axis=0).argmax())
    own = s.argmax(axis=1)
    order = np.partition(s, -2, axis=1)
    top, rows = s[np.arange(len(at)), own], np.arange(len(at))
    langs = own.copy()
    for i in np.flatnonzero(own != main):
        near = {main} | ({int(own[i - 1])} if i else set()) | ({int(own[i + 1])} if i + 1 < len(at) else set())
        home = max(near, key=lambda k: s[i, k])
        if own[i] not in near and top[i] - s[i, home] < limits.switch:
            langs[i] = home
        elif top[i] - s[i, main] < limits.switch / 2:
            langs[i] = main
    rival = np.where(langs == own, order[:, -2], top)
    conf = 1 / (1 + np.exp(-12 * (s[rows, langs] - rival + 0.05)))
    ends = np.append(np.flatnonzero(np.diff(langs)) + 1, len(at))
    out, i = [], 0
    for j in ends:
        out.append((at[i][0], at[j - 1][1], int(j - i), LANGS[langs[i]], float(conf[i:j].mean())))
        i = j
    return out


def segment(text: str | None, table: np.ndarray, limits: Limits = Limits()) -> list[tuple[int, int, int, str, float]]:
    """The stretches of one text."""
    at = sentences(text)
    return stretches(at, scores(table, [clean(text[a:b]) for a, b in at]), limits)


def segments(documents: DataFrame, table: np.ndarray, limits: Limits = Limits()) -> DataFrame:
    """One row per stretch of one language in each document (SEGMENTS).

    Null, empty and blank texts and texts without a full sentence give no row. Whole texts are read;
    label is the document's own label as an ISO code, null if it has none.
    """
    shared = documents.sparkSession.sparkContext.broadcast(table)  # K^3 trigrams by languages: 32 MB, whatever the data

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            places = [sentences(t) for t in pdf["text"]]
            s = scores(shared.value, [clean(t[a:b]) for t, at in zip(pdf["text"], places, strict=True) for a, b in at])
            rows, i = [], 0
            for d, label, at in zip(pdf["doc_id"], pdf["label"], places, strict=True):
                rows += [(d, label, k, *x) for k, x in enumerate(stretches(at, s[i : i + len(at)], limits))]
                i += len(at)
            out = pd.DataFrame(rows, columns=["doc_id", "label", "seg_no", "start", "end", "n_sentences", "lang", "confidence"])
            yield out.astype({"doc_id": "int64", "seg_no": "int32", "start": "int32", "end": "int32", "n_sentences": "int32", "confidence": "float64"})

    return spread(documents.select("doc_id", "text", label_code(F.col("lang")).alias("label"))).mapInPandas(run, SEGMENTS)


def document_languages(segs: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, label, lang, confidence, share, n_langs): the language with most sentences of each document.

    A document without a full sentence comes out as `und` with confidence and share 0 and no language.
    """
    per = segs.groupBy("doc_id", "label", "lang").agg(F.sum("n_sentences").alias("n"), F.avg("confidence").alias("confidence"))
    best = per.groupBy("doc_id").agg(F.max(F.struct("n", "confidence", "lang")).alias("m"), F.sum("n").alias("all"), F.count("*").alias("n_langs"))
    every = documents.select("doc_id", label_code(F.col("lang")).alias("label")).join(best, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return every.select("doc_id", "label", F.coalesce("m.lang", F.lit("und")).alias("lang"), zero(F.col("m.confidence")).alias("confidence"), zero(F.col("m.n") / F.col("all")).alias("share"), F.coalesce("n_langs", F.lit(0)).alias("n_langs"))


def wrong_labels(segs: DataFrame) -> DataFrame:
    """(doc_id, lang): the languages of each document that has no label, a wrong one, or several languages."""
    langs = segs.where("label IS NULL OR label <> 'zxx'").groupBy("doc_id", "label").agg(F.collect_set("lang").alias("langs"))
    case = langs.where("label IS NULL OR size(langs) > 1 OR NOT array_contains(langs, label)")
    return case.select("doc_id", F.explode("langs").alias("lang"))
