"""Languages of documents and of their segments, by Viterbi over per-word scores."""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.llm.bpe import slices, spread

#: Han, kana and their marks: each character is a word of its own.
CJK = "぀-ヿ㐀-䶿一-鿿々〆ｦ-ﾟ"
WORD = re.compile(rf"[{CJK}]|[^\W\d_{CJK}]+(?:['’][^\W\d_{CJK}]+)*")
#: The same for texts without Han and kana, in which plain classes will do.
ANY_CJK, WORD_PLAIN = re.compile(f"[{CJK}]"), re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Ends of sentences: full-width signs anywhere, others before white space, quotes, brackets or the end; and every line's end.
BREAK = re.compile(r"[。！？；]|[.!?;…](?=[\s\"'”’»)\]}]|$)|\n+")
#: A sign of a word that blanks part from others: \w matches Han and kana too, where it would take the whole clause. EDGE is \b for it.
SIGN = rf"[^\W{CJK}]"
EDGE = rf"(?:(?<!{SIGN})(?={SIGN})|(?<={SIGN})(?!{SIGN}))"
#: What isn't prose, replaced by a break or a blank before words are taken.
FRONT = re.compile(r"(?:^|\n)\s*---[ \t]*\n(?:[^\S\n]*[\w-]+[^\S\n]*:[^\n]*\n)+\s*---[ \t]*(?=\n|$)")
FENCE = re.compile(r"```.*?(?:```|$)|~~~.*?(?:~~~|$)", re.S)
TAG = re.compile(r"\[ACTION:\s*(?:FETCH|TENTACLE)\([^\n]*?\)\]|\[ACTION:\s*WRITE_NODE\([^;]*;;[^;]*;;[^;]*;;|\[ACTION:\s*\w+\(\s*\[?|\]?\s*\)\]", re.I)
_MARK = (
    r"【[^】\n]*】:?|<\|[^|>\n]*\|>|</?[A-Za-z][^>\n]*>|\[/?INST\]|https?://\S+|`[^`\n]*`|"
    r"^\s*[-*+]\s*\[[ xX]\](?:\[id:[^\]\n]*\])?|\[id:[^\]\n]*\]|^\s*#+\s|\[\[[^\]\n]*\]\]|^\s*\[[0-9a-f]{4,}\]\s*#\d+:?|"
    r"%s%s*[_\d/\\=@]%s*%s")
MARK, MARK_PLAIN = re.compile(_MARK % (EDGE, SIGN, SIGN, EDGE), re.M), re.compile(_MARK % (r"\b", r"\w", r"\w", r"\b"), re.M)
JSON_KEY = re.compile(r"[\"']?[\w-]+[\"']\s*:\s*")
#: A single quoted term, often foreign or invented, says nothing about the language around it. Terms of Han and kana go only
#: where they are too short for a sentence and follow a word of another script, since elsewhere they are part of the prose.
QUOTES = ('""', "“”", "„“", "„”", "””", "«»", "»«", "「」", "『』", "‘’", "’’", "‚‘", "''")
_WITHIN = rf"(?:{SIGN}|-)+"
_SHORT = rf"[{CJK}]{{1,4}}"
TERM = re.compile(
    f"(?=[{''.join(QUOTES)}])(?:" + "|".join(rf"{a}\s*{_WITHIN}\s*{b}" for a, b in QUOTES) + "|"
    + rf"(?:(?<={SIGN})|(?<={SIGN}[ ]))(?:" + "|".join(rf"{a}\s*{_SHORT}\s*{b}" for a, b in QUOTES) + rf")(?![ ]?[{CJK}]))")
HIDDEN = re.compile("[­​-‏‪-‮⁠-⁤﻿︎️]")


#: Words whose gains are held at once, or those of one longer sentence; it bounds memory and changes no result.
WORDS_AT_ONCE = 500_000


@dataclass(frozen=True)
class Settings:
    """switch: penalty for a change of language between words of a sentence. turn: between sentences. temper: by what the scores are divided
    before confidences are computed from them, since words aren't independent. foreign: score of a word in a language that isn't written in
    its script. least_words, least_signs: words, or CJK characters, that make a sentence. fitted_rows: most rows of reference
    samples that the model is fitted on; fitted_documents: most labelled documents from which it learns further words."""

    switch: float = 10.0
    turn: float = 4.0
    temper: float = 1.0
    foreign: float = -5.0
    least_words: int = 3
    least_signs: int = 5
    fitted_rows: int = 20_000
    fitted_documents: int = 2_000


def plain(word: str) -> str:
    """Lower case, composed."""
    return unicodedata.normalize("NFC", word).lower()


def bare(word: str) -> str:
    """Without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def script(word: str) -> str:
    c = ord(word[0])
    if 0x3040 <= c <= 0x30FF or 0xFF66 <= c <= 0xFF9F:
        return "kana"
    if 0x3005 <= c <= 0x3007 or 0x3400 <= c <= 0x9FFF:
        return "han"
    if c < 0x250 or 0x1E00 <= c <= 0x1EFF:
        return "latin"
    if 0x400 <= c <= 0x52F:
        return "cyrillic"
    return unicodedata.name(word[0], "other").split(" ")[0].lower()


def _features(word: str) -> list[tuple[int, str]]:
    if script(word) in ("han", "kana"):
        return [(0, word)]
    w = f"^{word}$"
    out = [(0, w)]
    for n in (2, 3, 4):
        out += [(n, w[i : i + n]) for i in range(len(w) - n + 1)]
    return out


class Model:
    """Naive Bayes over whole words and their character n-grams, per language; small enough to send with a task."""

    def __init__(self, samples: list[tuple[str, str]], s: Settings = Settings()):
        self.s = s
        self.langs = sorted({lang for lang, _ in samples})
        counts: dict[tuple[int, str], np.ndarray] = defaultdict(lambda: np.zeros(len(self.langs)))
        by_script: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(self.langs)))
        seen: dict[str, Counter[str]] = {lang: Counter() for lang in self.langs}
        for lang, text in samples:
            seen[lang].update(words_of(text))
        for k, lang in enumerate(self.langs):
            for w, n in seen[lang].items():
                by_script[script(w)][k] += n
                for form in {w, bare(w)}:
                    for f in _features(form):
                        counts[f][k] += n
        sums = sum(by_script.values(), np.zeros(len(self.langs)))
        #: script -> which languages are written in it (at least a twentieth of their words).
        self.allowed = {name: n >= 0.05 * np.maximum(sums, 1) for name, n in by_script.items()}
        totals: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(len(self.langs)))
        kinds: Counter[int] = Counter()
        for (n, _), c in counts.items():
            totals[n] += c
            kinds[n] += 1
        self.logp = {f: np.log((c + 0.1) / (totals[f[0]] + 0.1 * kinds[f[0]])).astype(np.float32) for f, c in counts.items()}
        self.floor = {n: np.log(0.1 / (totals[n] + 0.1 * kinds[n])).astype(np.float32) for n in kinds}

    def score(self, word: str) -> np.ndarray:
        """Log posterior of each language for a word; languages that aren't written in its script get the foreign score."""
        allowed = self.allowed.get(script(word))
        if allowed is None or not allowed.any():
            return np.zeros(len(self.langs), np.float32)
        x = np.zeros(len(self.langs), np.float32)
        for f in _features(word):
            x += self.logp[f] if f in self.logp else self.floor.get(f[0], 0)
        x = np.where(allowed, x if script(word) in ("han", "kana") else x / 2.5, -np.inf)
        x -= x.max()
        x -= math.log(np.exp(x).sum())
        return np.maximum(x, self.s.foreign).astype(np.float32)


def words_of(sentence: str) -> list[str]:
    return [plain(w) for w in WORD.findall(sentence)]


def _strings(value: object) -> Iterator[str]:
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        for v in value.values():
            yield from _strings(v)
    elif isinstance(value, list):
        for v in value:
            yield from _strings(v)


def prose(text: str) -> str:
    """The text without front matter, JSON keys, action tags, markup, code, ids and numbers; parts stay in order, apart by line breaks."""
    t = HIDDEN.sub("", unicodedata.normalize("NFC", text)).replace("\r\n", "\n").replace("\r", "\n")
    if t.lstrip()[:1] in ("{", "["):
        try:
            t = "\n".join(_strings(json.loads(t)))
        except ValueError:
            lines = []
            for line in t.split("\n"):
                try:
                    lines.append("\n".join(_strings(json.loads(line))) if line.lstrip()[:1] == "{" else line)
                except ValueError:
                    lines.append(JSON_KEY.sub(" ", line.replace("\\n", "\n").replace('\\"', '"')))
            t = "\n".join(lines)
    t = FRONT.sub("\n", t)
    t = FENCE.sub("\n", t)
    if "[action:" in t.lower():
        t = TAG.sub("\n", t)
    t = (MARK if ANY_CJK.search(t) else MARK_PLAIN).sub(" ", t)
    return TERM.sub(" ", t)


@dataclass
class Sentences:
    """The sentences of a batch of texts, in order: doc (place of the text in the batch), lang (number of the language), sure (its
    posterior), words (how many); parts are the sentences themselves."""

    doc: np.ndarray
    lang: np.ndarray
    sure: np.ndarray
    words: np.ndarray
    parts: list[str]

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first sentence, number within its text from 1, segments of its text) of each longest run of sentences in one language."""
        fresh = np.ones(len(self.doc), bool)
        fresh[1:] = (self.doc[1:] != self.doc[:-1]) | (self.lang[1:] != self.lang[:-1])
        start = np.flatnonzero(fresh)
        _, first, count = np.unique(self.doc[start], return_index=True, return_counts=True)
        return start, np.arange(len(start)) - np.repeat(first, count) + 1, np.repeat(count, count)


class Labeller:
    """One per task: the model with the scores of the words met so far. Texts are labelled in batches, all their words at once."""

    def __init__(self, model: Model):
        self.model, self.s = model, model.s
        self.at: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.langs)), np.float32)
        #: 1: a sign of Han or kana, 2: a word of several letters, 0: any other.
        self.kind = np.zeros(1024, np.int8)

    def learn(self, word: str, score: np.ndarray) -> int:
        i = self.at[word] = len(self.at)
        if i >= len(self.table):
            self.table, self.kind = np.concatenate([self.table, np.zeros_like(self.table)]), np.concatenate([self.kind, np.zeros_like(self.kind)])
        self.table[i] = score
        self.kind[i] = 2 if len(word) > 1 else int(script(word) in ("han", "kana"))
        return i

    def ids(self, words: list[str]) -> np.ndarray:
        at = self.at
        return np.array([at[w] if w in at else self.learn(w, self.model.score(w)) for w in words], np.int64)

    @staticmethod
    def split(text: str | None) -> list[tuple[list[str], str]]:
        """(words, part) of the parts of the prose, lower-cased; parts without words are left out."""
        if not text or text.isspace():
            return []
        t = prose(text).lower()
        word = WORD if ANY_CJK.search(t) else WORD_PLAIN
        ends = [0, *(m.end() for m in BREAK.finditer(t)), len(t)]
        parts = [(word.findall(t, i, j), t[i:j]) for i, j in zip(ends, ends[1:]) if i < j]
        return [x for x in parts if x[0]]

    def label(self, texts: list[str | None]) -> Sentences:
        """The parts that have enough words for a sentence, each in the language of most of its words on the best way through its whole text."""
        if len(self.at) > 200_000:
            self.at = {}
        words: list[str] = []
        parts: list[str] = []
        size, doc = [], []
        for d, t in enumerate(texts):
            for w, part in self.split(t):
                words += w
                size.append(len(w))
                doc.append(d)
                parts.append(part)
        n, doc = np.array(size, np.int64), np.array(doc, np.int64)
        ids = self.ids(words)
        begin = np.cumsum(n) - n
        if len(n):
            counts = [np.add.reduceat(self.kind[ids] == k, begin) for k in (1, 2)]
            keep = (counts[0] >= self.s.least_signs) | (counts[1] >= self.s.least_words)
            ids, n, doc, parts = ids[np.repeat(keep, n)], n[keep], doc[keep], [p for p, k in zip(parts, keep) if k]
        if not len(n):
            return Sentences(doc, n, n.astype(float), n, [])
        lang, sure = self._ways(self.table[ids], n, doc)
        return Sentences(doc, lang, sure, n, parts)

    def _ways(self, score: np.ndarray, n: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, posterior) of each sentence of n words, given the words' scores."""
        k = score.shape[1]
        begin = np.cumsum(n) - n
        sentence = np.repeat(np.arange(len(n)), n)
        sums = np.add.reduceat(score, begin, dtype=np.float64)
        lead = sums.argmax(axis=1)
        # A sentence is one step if no stretch of its words gains the penalty, and its neighbours are led by its language; at a change a way may cross it.
        alike = (doc[1:] == doc[:-1]) & (lead[1:] != lead[:-1])
        single = ~np.append(alike, False) & ~np.append(False, alike) & self._even(score, lead, n)
        steps = np.where(single, 1, n)
        owner = np.repeat(np.arange(len(n)), steps)
        first = np.cumsum(steps) - steps
        unit = np.empty((len(owner), k))
        unit[first[single]] = sums[single]
        loose = ~single[sentence]
        unit[(first[sentence] + np.arange(len(sentence)) - begin[sentence])[loose]] = score[loose]
        weight = np.where(single, n, 1)[owner]
        penalty = np.where(np.append(-1, owner[:-1]) == owner, self.s.switch, self.s.turn)
        of = doc[owner]
        start = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        length = np.diff(np.append(start, len(of)))
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        live = [int(np.searchsorted(-length, -t, side="left")) for t in range(int(length[0]))]  # texts that have a step t
        path = self._best(unit, penalty, start, length, live)
        sure = self._posterior(unit, penalty, start, length, live)
        votes = np.bincount(owner * k + path, weights=weight, minlength=len(n) * k).reshape(-1, k)
        lang = votes.argmax(axis=1)
        return lang, np.add.reduceat(sure[np.arange(len(owner)), lang[owner]] * weight, first) / n

    def _even(self, score, lead, n) -> np.ndarray:
        """Whether no stretch of a sentence's words gains more than the switching penalty in another language than its leading one; some sentences at a time."""
        ends = np.cumsum(n)
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], WORDS_AT_ONCE)), len(n)))
        return np.concatenate([
            self._even_part(score[(ends[i - 1] if i else 0) : ends[j - 1]], lead[i:j], n[i:j]) for i, j in zip(cuts, cuts[1:])])

    def _even_part(self, score, lead, n) -> np.ndarray:
        begin, sentence = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
        gain = score - score[np.arange(len(score)), lead[sentence]][:, None]
        limit = self.s.switch + 1e-4
        even = np.add.reduceat(np.maximum(gain, 0), begin, dtype=np.float64).max(axis=1) <= limit  # no stretch gains more than all gains together
        if even.all():
            return even
        some = np.repeat(~even, n)
        gain, n = gain[some].astype(np.float64), n[~even]
        begin, sentence = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
        total = np.cumsum(gain, axis=0)
        total -= (total[begin] - gain[begin])[sentence]
        before = total - gain
        fall = 16.0 * (2 + float(np.abs(total).max()))  # takes each sentence below all before it, so that one running minimum serves all
        low = np.minimum.accumulate(before - (sentence * fall)[:, None], axis=0) + (sentence * fall)[:, None]
        even[~even] = np.maximum.reduceat((total - low).max(axis=1), begin) <= limit
        return even

    @staticmethod
    def _best(unit, penalty, start, length, live) -> np.ndarray:
        """The best way through the steps of each text (Viterbi), step by step in all texts at once."""
        best = unit[start].copy()
        back = np.empty(unit.shape, np.int8)
        same = np.arange(unit.shape[1], dtype=np.int8)
        for t, m in enumerate(live[1:], 1):
            at, b = start[:m] + t, best[:m]
            top = b.argmax(axis=1)
            jump = b[np.arange(m), top] - penalty[at]
            back[at] = np.where(b >= jump[:, None], same, top[:, None].astype(np.int8))
            best[:m] = np.maximum(b, jump[:, None]) + unit[at]
        path = np.empty(len(unit), np.int64)
        now = best.argmax(axis=1)
        path[start + length - 1] = now
        for t in range(len(live) - 1, 0, -1):
            m = live[t]
            at = start[:m] + t
            path[at - 1] = back[at, path[at]]
        return path

    def _posterior(self, unit, penalty, start, length, live) -> np.ndarray:
        """Posterior of each language at each step, by forward and backward sums over all ways."""
        like = np.exp((unit - unit.max(axis=1, keepdims=True)) / self.s.temper)
        q = np.exp(-penalty / self.s.temper)[:, None]
        ahead = np.empty(unit.shape)
        ahead[start] = like[start] / like[start].sum(axis=1, keepdims=True)
        for t, m in enumerate(live[1:], 1):
            at = start[:m] + t
            x = (ahead[at - 1] * (1 - q[at]) + q[at]) * like[at]
            ahead[at] = x / x.sum(axis=1, keepdims=True)
        behind = np.ones(unit.shape)
        for t in range(len(live) - 1, 0, -1):
            m = live[t]
            at = start[:m] + t
            x = behind[at] * like[at]
            x = x * (1 - q[at]) + q[at] * x.sum(axis=1, keepdims=True)
            behind[at - 1] = x / x.sum(axis=1, keepdims=True)
        p = ahead * behind
        return p / p.sum(axis=1, keepdims=True)

    def segments(self, text: str | None) -> list[tuple[str, float, int, str]]:
        """(language, confidence, words, text) of each longest run of sentences in one language."""
        found = self.label([text])
        start, _, _ = found.segments()
        out = []
        for i, j in zip(start, np.append(start[1:], len(found.doc))):
            n = int(found.words[i:j].sum())
            out.append((self.model.langs[found.lang[i]], float((found.sure[i:j] * found.words[i:j]).sum() / n), n, " ".join(p.strip() for p in found.parts[i:j])))
        return out


def given_label() -> Column:
    """The label in lower case up to the first - or _; null if missing or empty."""
    return F.nullif(F.regexp_extract(F.lower("lang"), "^([^-_]*)", 1), F.lit(""))


def fit(samples: DataFrame, documents: DataFrame | None = None, s: Settings = Settings()) -> Model:
    """A model of reference rows (lang, text) and of labelled documents, both bounded and chosen by hash.

    A first model is fitted on at most fitted_rows reference rows (rows with a null are left out). Of at most
    fitted_documents documents it keeps those that are in one language, surely, and labelled so; the model is then
    fitted on these as well, which teaches it words that the reference rows lack. Wrong labels thus don't matter.
    """
    rows = samples.filter("lang is not null and text is not null").select("lang", "text").orderBy(F.xxhash64("text", "lang"), "text").limit(s.fitted_rows).collect()
    known = [(r["lang"], r["text"]) for r in rows]
    model = Model(known, s)
    if documents is None or not known:
        return model
    chosen = documents.select("doc_id", "text", given_label().alias("label")).filter(F.col("label").isin(model.langs) & F.col("text").isNotNull())
    more, first = [], Labeller(model)
    for r in chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.fitted_documents).select("label", "text").toLocalIterator():
        got = first.segments(r["text"])
        if len(got) == 1 and got[0][0] == r["label"] and got[0][1] >= 0.9:
            more.append((r["label"], got[0][3]))
    return Model(known + more, s)


def segments(documents: DataFrame, samples: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, seg_no, lang, confidence, n_words, n_segments, label) of all segments of all documents.

    Null, empty and blank texts, and texts without any sentence, give no rows. confidence is the mean posterior of the
    language at its sentences over all ways through the text, by words. label: see given_label. Rows stay where they are read.
    """
    model = documents.sparkSession.sparkContext.broadcast(fit(samples, documents, s))  # bounded by the rows it is fitted on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lab = Labeller(model.value)
        langs = pa.array(model.value.langs, pa.string())
        for whole in batches:
            for b in slices(whole, "text"):
                found = lab.label(b.column("text").to_pylist())
                start, number, of = found.segments()
                words = np.add.reduceat(found.words, start) if len(start) else found.words
                sure = np.add.reduceat(found.sure * found.words, start) / words if len(start) else found.sure
                at = pa.array(found.doc[start])
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id").take(at), pa.array(number.astype(np.int32)), langs.take(pa.array(found.lang[start])),
                    pa.array(sure), pa.array(words.astype(np.int32)), pa.array(of.astype(np.int32)), b.column("label").take(at)],
                    ["doc_id", "seg_no", "lang", "confidence", "n_words", "n_segments", "label"])

    rows = documents.select("doc_id", "text", given_label().alias("label"))
    return spread(rows, "doc_id").mapInArrow(
        run, f"doc_id {dict(rows.dtypes)['doc_id']}, seg_no int, lang string, confidence double, n_words int, n_segments int, label string")


def wrong_labels(found: DataFrame) -> DataFrame:
    """(doc_id, seg_no, lang): all segments of documents with more than one, or whose label is missing or another language."""
    return found.filter((F.col("n_segments") > 1) | ~F.col("label").eqNullSafe(F.col("lang"))).select("doc_id", "seg_no", "lang")


def document_languages(found: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence, n_segments): the language of most words of each document that has a sentence."""
    per = found.groupBy("doc_id", "lang").agg(F.sum("n_words").alias("n"), F.sum(F.col("confidence") * F.col("n_words")).alias("c"), F.count("*").alias("k"))
    return (
        per.groupBy("doc_id").agg(F.max(F.struct("n", "lang", "c")).alias("m"), F.sum("k").alias("n_segments"))
        .select("doc_id", "m.lang", F.round(F.col("m.c") / F.col("m.n"), 6).alias("confidence"), "n_segments")
    )
