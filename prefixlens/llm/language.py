"""Languages of documents and of their stretches: a linear-chain conditional random field over words.

Lines of logs, code and JSON are set aside. The words of what remains form one chain per document; a word's
features are the word, its affixes, character n-grams, script and the function-word lexicon, and transitions
between languages are learned with them. Forward-backward gives every word a probability for each language.
A sentence gets the mean over its words; consecutive sentences of one language form a segment whose
confidence is the mean over its words; the document's language is the one with most words (a Han character is
a word).

The field is trained on the driver on a bounded set of labelled samples (``MAX_SAMPLES``) strung together to
code-switched chains, with accents kept and removed; all documents are labelled whole, vectorised over the
chains of an Arrow batch. Emissions are computed once per distinct word.

Defined cases: null, empty and wholly technical texts have no segment and no language; a sentence without
words (numbers, identifiers) belongs to none; a fragment without end mark is no sentence: one of at least
``FRAGMENT`` words counts for segments and document, a shorter one goes with the segment before it; ties go
to the first language in sorted order; rows of one id are one document; languages without samples are never
assigned; no samples is an error.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixlens.functions.strings import unicode_trim
from prefixlens.llm.words import hash_text

#: Labelled samples used at most, the smallest sample ids of each language in turn.
MAX_SAMPLES = 2000
#: Words from which a piece without end mark counts as a stretch of its own.
FRAGMENT = 5
#: Words of a chain run through at once, and words that a piece sees of its neighbours.
CHAIN, OVERLAP = 512, 64
#: Hashed feature space.
SPACE = 1 << 15
ROUNDS = 50
#: Frequent function words, one lexicon feature per list (fixed values).
LEXICON = {
    "en": "the of and to in is that it for was on are as with they be at this have from or had by not but what there we can an your which their if do will each how them then",
    "de": "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem",
    "fr": "le la les et des en un du une que est pour qui dans par plus au sur ne se ce il sont avec pas son cette ou aux elle nous vous mais sans",
    "es": "el los del las se con una por para su es al lo como o pero sus ya este porque esta entre cuando muy sobre ser tiene hay donde quien desde todo nos",
    "pt": "o os da do em um uma com na no para dos se mais por ao das foi mas ele seu sua ou quando muito nos isso ela entre depois sem mesmo aos seus quem",
    "nl": "de het een van dat niet te zijn op aan met voor er maar om hem dan zou of wat mijn zo door over ze zich bij ook tot je naar kan nog wordt",
}
#: ISO 639-1 code, ISO 639-2 forms (fixed values).
ISO = {
    "ar": ("ara",), "cs": ("ces", "cze"), "da": ("dan",), "de": ("deu", "ger"), "el": ("ell", "gre"), "en": ("eng",), "es": ("spa",),
    "fi": ("fin",), "fr": ("fra", "fre"), "he": ("heb",), "hi": ("hin",), "hu": ("hun",), "it": ("ita",), "ja": ("jpn",), "ko": ("kor",),
    "nl": ("nld", "dut"), "no": ("nor",), "pl": ("pol",), "pt": ("por",), "ro": ("ron", "rum"), "ru": ("rus",), "sv": ("swe",),
    "tr": ("tur",), "uk": ("ukr",), "vi": ("vie",), "zh": ("zho", "chi"),
}

#: A word: a Han character, or letters that no number, path or identifier is made with.
_TOKEN = re.compile(r"[㐀-鿿]|(?<![\w/=.])[^\W\d_㐀-鿿]++(?![0-9_/=]|-\d|\.\w)")
_BREAK = re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？][\"”’」』)]*\s*")
_ENDS = re.compile(r"[.!?…。！？][\"'”’»)\]」』]*\s*$")
_PLAIN = re.compile(r"(?<![^\s\"'“”‘’«»(\[>#*-])[^\W\d_]+(?:['’-][^\W\d_]+)*(?=[.,;:!?…。！？，；：、)\]\"'“”’»]*(?:\s|$))|[㐀-鿿]+")


def same_language(label: str | None, language: str) -> bool:
    """Whether a label names a language: two- or three-letter code, any case, with or without region or script."""
    if not label:
        return False
    code = re.split(r"[-_\s]", label.strip().lower())[0]
    language = language.lower()
    known = {language, *ISO.get(language, ())}
    for two, three in ISO.items():
        if language in three:
            known |= {two, *three}
    return code in known


#: Labels that name no language (fixed values).
PLACEHOLDERS = ("", "und", "unk", "unknown", "mul", "mis", "zxx", "xx", "none", "null", "n/a")


def language_code(label: Column) -> Column:
    """The two-letter code of a label in any known form, null for placeholders; another label's first part as it is."""
    code = F.split(F.lower(unicode_trim(label)), r"[-_\s]")[0]
    two = F.create_map(*[F.lit(x) for short, long in ISO.items() for form in long for x in (form, short)])
    return F.when(~code.isin(*PLACEHOLDERS), F.coalesce(F.try_element_at(two, code), code))


#: JSON, a position in a source file, a clock time, a duration in brackets, the start of a definition.
_MARKS = re.compile(r"^[{\[].*[}\]],?$|\"[^\"\s]*\"\s*:|^\S+:\d+(?::\d+)?:\s|^\[?\d{1,4}[-:]\d\d[-:]\d\d\b|\(\d+(?:\.\d+)?\s?m?s\)$|[{}]$|^(?:def|class|const|let|var|function)\s+\w+\s*[(=:{]|^(?:import|from)\s+[\w.]+(?:\s+import\b.*)?$")


def technical(line: str) -> bool:
    """Logs, code and JSON: telling marks, or few of the characters lie in plain words.

    Less than half, or a third where the line ends like a sentence.
    """
    if _MARKS.search(line):
        return True
    total = len(line) - line.count(" ") - line.count("\t")
    if total == 0:
        return True
    return sum(len(w) for w in _PLAIN.findall(line)) < total / (3 if line[-1] in ".!?。！？" else 2)


def prose(text: str) -> Iterator[tuple[int, str]]:
    """(start, text) of the stretches of running text: fenced and technical lines are left out.

    A heading is a stretch of its own, without its marker.
    """
    at, start, fenced = 0, -1, False
    for line in text.split("\n"):
        bare = line.strip()
        heading = bare.startswith("# ")
        if heading:
            bare = bare[2:].lstrip()
        if not heading and bare.startswith(("```", "~~~")):
            fenced, stop = not fenced, True
        else:
            stop = fenced or not bare or technical(bare)
        if (stop or heading) and start >= 0:
            yield start, text[start : at - 1]
            start = -1
        if heading and not stop:
            yield at + len(line.rstrip()) - len(bare), bare
        elif not stop and start < 0:
            start = at
        at += len(line) + 1
    if start >= 0:
        yield start, text[start:]


def sentences(text: str) -> Iterator[tuple[int, int, bool, list[str]]]:
    """(start, end, whether it has an end mark, words) of the sentences of the running text."""
    for start, block in prose(text):
        at, low = 0, block.lower()
        if len(low) != len(block):  # positions must hold
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in block)
        for m in _BREAK.finditer(block):
            end = m.end()
            if ws := _TOKEN.findall(low, at, end):
                yield start + at, start + at + len(block[at:end].rstrip()), True, ws
            at = end
        if at < len(block) and (ws := _TOKEN.findall(low, at)):
            yield start + at, start + len(block), _ENDS.search(block, at) is not None, ws


def plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def _lexicon() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for language, listed in LEXICON.items():
        for w in listed.split():
            out.setdefault(w, []).append(language)
    return out


_LISTED = _lexicon()


#: What a word shows in training: all of it, only its parts, nothing (so that the chain must bridge it).
WHOLE, PARTS, NOTHING = 2, 1, 0


def features(word: str, shown: int = WHOLE) -> list[int]:
    """Hashed features of a word."""
    if shown == NOTHING:
        return []
    if "㐀" <= word[0] <= "鿿":
        return [hash_text(f) % SPACE for f in ("script:han", *(("w:" + word,) if shown == WHOLE else ()))]
    padded = f"^{word}$"
    names = {padded[i : i + n] for n in (2, 3, 4) for i in range(len(padded) - n + 1)}
    names |= {f"{side}:{part}" for n in (1, 2, 3) if len(word) > n for side, part in (("p", word[:n]), ("s", word[-n:]))}
    names |= {f"c:{c}" for c in word if not c.isascii()}
    if shown == WHOLE:
        names.add("w:" + word)
        names |= {"lex:" + language for language in _LISTED.get(word, ())}
    return [hash_text(f) % SPACE for f in sorted(names)]


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` per index."""
    return np.column_stack([np.bincount(at, values[:, j], n) for j in range(values.shape[1])])


class ChainField:
    """Languages, feature weights and transition weights."""

    def __init__(self, languages: list[str], weights: np.ndarray, transitions: np.ndarray):
        self.languages, self.weights, self.transitions = languages, weights, transitions

    def scores(self, word: str) -> np.ndarray:
        f = features(word)
        return self.weights[f].sum(axis=0) / np.sqrt(len(f))

    @staticmethod
    def posteriors(emissions: np.ndarray, transitions: np.ndarray, sizes: np.ndarray, pairs: bool = False):
        """Word probabilities of many chains at once, by forward-backward.

        ``emissions``: exp of scores of all words, chain after chain. Chains are taken longest first, so step t
        works on the chains that are still running. With ``pairs`` also the expected transitions.
        """
        order = np.argsort(-sizes, kind="stable")
        lengths = sizes[order]
        steps, k = int(lengths[0]) if len(lengths) else 0, emissions.shape[1]
        running = np.searchsorted(-lengths, -np.arange(steps), "left")
        # words are laid out step by step, so that each step works on one slice
        first = np.append(0, np.cumsum(running))
        rank = np.empty(len(sizes), np.int64)
        rank[order] = np.arange(len(sizes))
        place = np.arange(len(emissions)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = first[place] + np.repeat(rank, sizes)
        e = np.empty_like(emissions)
        e[place] = emissions
        move = np.exp(transitions)
        forward, backward = np.empty_like(e), np.ones_like(e)
        for t in range(steps):
            i, n = first[t], running[t]
            a = e[i : i + n] if t == 0 else (forward[first[t - 1] : first[t - 1] + n] @ move) * e[i : i + n]
            forward[i : i + n] = a / (a @ np.ones(k))[:, None]
        for t in range(steps - 2, -1, -1):
            i, j, n = first[t], first[t + 1], running[t + 1]
            b = (e[j : j + n] * backward[j : j + n]) @ move.T
            backward[i : i + n] = b / (b @ np.ones(k))[:, None]
        p = forward * backward
        p /= p.sum(axis=1, keepdims=True)
        p = p[place]
        if not pairs:
            return p
        inner = np.ones(len(emissions), bool)
        inner[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
        i = np.flatnonzero(inner)
        joint = forward[place[i - 1]][:, :, None] * move[None] * (e * backward)[place[i]][:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        return p, joint.sum(axis=0), i

    @classmethod
    def train(cls, samples: list[tuple[str, str]], rounds: int = ROUNDS, seed: int = 5) -> ChainField:
        """Fit by gradient ascent with adaptive steps and an L2 prior on chains of two to four samples."""
        languages = sorted({language for language, _ in samples})
        if not languages:
            raise ValueError("no labelled samples")
        k, rng = len(languages), np.random.default_rng(seed)
        number: dict[tuple[str, int], int] = {}
        chains: dict[int, list[tuple[list[str], int]]] = {}
        for j, (language, text) in enumerate(samples):
            chains[j] = [(ws, languages.index(language)) for _, _, _, ws in sentences(text)]
        ids: list[int] = []
        labels: list[int] = []
        sizes: list[int] = []
        for _ in range(2 * len(samples)):
            size, last = 0, int(rng.integers(len(samples)))
            bare, sparse = rng.random() < 0.4, rng.random() < 0.5
            for _ in range(int(rng.integers(1, 4))):
                for ws, y in chains[last]:
                    for w in ws:
                        w = plain(w) if bare else w
                        if not w:
                            continue
                        r = rng.random()
                        key = ("", NOTHING) if r < 0.3 else (w, PARTS if sparse and r < 0.7 else WHOLE)
                        ids.append(number.setdefault(key, len(number)))
                        labels.append(y)
                        size += 1
                if rng.random() < 0.6:
                    last = int(rng.integers(len(samples)))
            sizes.append(size)
        sizes_, ids_, labels_ = np.array([s for s in sizes if s]), np.array(ids), np.array(labels)
        feats = [features(w, shown) for w, shown in number]
        rows = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
        cols, scale = np.concatenate([np.array(f, np.int64) for f in feats]), 1 / np.sqrt([max(len(f), 1) for f in feats])
        used, cols = np.unique(cols, return_inverse=True)
        weights, transitions = np.zeros((len(used), k)), np.zeros((k, k))
        grown, grown_t = np.full_like(weights, 1e-6), np.full_like(transitions, 1e-6)
        observed_t = None
        for _ in range(rounds):
            per_word = _sums(rows, weights[cols], len(feats)) * scale[:, None]
            e = np.exp(per_word - per_word.max(axis=1, keepdims=True))[ids_]
            p, expected, inner = cls.posteriors(e, transitions, sizes_, pairs=True)
            if observed_t is None:
                observed_t = np.zeros((k, k))
                np.add.at(observed_t, (labels_[inner - 1], labels_[inner]), 1.0)
            p = -p
            p[np.arange(len(labels_)), labels_] += 1
            word_gradient = _sums(ids_, p, len(feats)) * scale[:, None]
            gradient = _sums(cols, word_gradient[rows], len(used)) - 0.5 * weights
            step_t = observed_t - expected - 0.1 * transitions
            grown += gradient**2
            grown_t += step_t**2
            weights += 0.5 * gradient / np.sqrt(grown)
            transitions += 0.8 * step_t / np.sqrt(grown_t)
        whole = np.zeros((SPACE, k))
        whole[used] = weights
        return cls(languages, whole, transitions)


class _Numbers(dict):
    """Word -> number, asked for on the first meeting."""

    def __init__(self, new):
        self.new = new

    def __missing__(self, word: str) -> int:
        i = self[word] = self.new(word, len(self))
        return i


class Tagger:
    """Labels the sentences of many texts with one field; keeps the emissions of the words it has met."""

    BOUND = 500_000

    def __init__(self, field: ChainField):
        self.field = field
        self.number = _Numbers(self._new)
        self.rows = np.empty((1024, len(field.languages)))

    def _new(self, word: str, i: int) -> int:
        if i == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        s = self.field.scores(word)
        self.rows[i] = np.exp(s - s.max())
        return i

    def _posteriors(self, emissions: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Word probabilities. Chains over CHAIN words are taken in pieces that overlap by OVERLAP on both sides."""
        if sizes.max() <= CHAIN + 2 * OVERLAP:
            return ChainField.posteriors(emissions, self.field.transitions, sizes)
        pieces = -(-sizes // CHAIN)
        chain = np.repeat(np.arange(len(sizes)), pieces)
        start = (np.arange(len(chain)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * CHAIN
        low, high = np.maximum(start - OVERLAP, 0), np.minimum(start + CHAIN + OVERLAP, sizes[chain])
        first = np.cumsum(high - low) - (high - low)
        offset = np.arange(first[-1] + high[-1] - low[-1]) - np.repeat(first, high - low)
        place = np.repeat(low, high - low) + offset
        at = np.repeat((np.cumsum(sizes) - sizes)[chain], high - low) + place
        p = ChainField.posteriors(emissions[at], self.field.transitions, high - low)
        return p[(place >= np.repeat(start, high - low)) & (place < np.repeat(start + CHAIN, high - low))]

    def label(self, texts: list[str | None]) -> list[list[tuple[int, int, bool, int, np.ndarray]]]:
        """Per text its sentences: start, end, has an end mark, words, language probabilities."""
        if len(self.number) > self.BOUND:
            self.number.clear()
        found = [list(sentences(t)) if t else [] for t in texts]
        ids = np.fromiter(map(self.number.__getitem__, chain.from_iterable(s[3] for f in found for s in f)), np.int64)
        if not len(ids):
            return [[] for _ in texts]
        per_sentence = np.fromiter((len(s[3]) for f in found for s in f), np.int64)
        sizes = np.fromiter((sum(len(s[3]) for s in f) for f in found), np.int64, len(found))
        p = self._posteriors(self.rows[ids], sizes[sizes > 0])
        means = np.add.reduceat(p, np.cumsum(per_sentence) - per_sentence) / per_sentence[:, None]
        out, n = [], 0
        for f in found:
            out.append([(a, b, whole, len(ws), means[n + i]) for i, (a, b, whole, ws) in enumerate(f)])
            n += len(f)
        return out


SEGMENTS = "doc_id bigint, label string, segment bigint, language string, confidence double, start bigint, end bigint, sentences bigint, words bigint"


def segments(documents: DataFrame, samples: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang", sample_lang: str = "lang", sample_text: str = "text", sample_id: str = "sample_id", max_samples: int = MAX_SAMPLES) -> DataFrame:
    """Stretches of one language of every document, in order: SEGMENTS. Positions are characters, end exclusive."""
    labelled = samples.where(F.col(sample_lang).isNotNull() & F.col(sample_text).isNotNull())
    most = max(max_samples, labelled.select(sample_lang).distinct().count())  # every language has one at least
    place = F.row_number().over(Window.partitionBy(sample_lang).orderBy(sample_id))
    first = labelled.withColumn("_n", place).where(F.col("_n") <= most).orderBy("_n", sample_lang).limit(most)
    rows = first.orderBy(sample_id).select(sample_lang, sample_text).collect()
    sent = documents.sparkSession.sparkContext.broadcast(ChainField.train([tuple(r) for r in rows]))  # SPACE x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(sent.value)
        names = tagger.field.languages
        for b in batches:
            for piece in range(0, b.num_rows, 1000):
                part = b.slice(piece, 1000)
                cols: list[list] = [[] for _ in range(9)]
                for doc, lab, found in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), tagger.label(part.column(2).to_pylist())):
                    runs: list[list] = []
                    for a, z, whole, n, p in found:
                        best = int(p.argmax())
                        if runs and not whole and n < FRAGMENT:
                            runs[-1][2] = z  # a short quotation or heading does not part two sentences
                        elif runs and runs[-1][0] == best:
                            r = runs[-1]
                            r[2], r[3], r[4], r[5] = z, r[3] + whole, r[4] + n, r[5] + n * p[best]
                        else:
                            runs.append([best, a, z, int(whole), n, n * p[best]])
                    for i, (best, a, z, whole, n, mass) in enumerate(runs):
                        for c, v in zip(cols, (doc, lab, i, names[best], float(mass / n), a, z, whole, n)):
                            c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64(), *[pa.int64()] * 4))],
                    names=["doc_id", "label", "segment", "language", "confidence", "start", "end", "sentences", "words"],
                )

    return documents.select(F.col(f"`{doc_id}`").cast("bigint"), F.col(f"`{label}`").cast("string"), F.col(f"`{text}`").cast("string")).mapInArrow(run, SEGMENTS)


def document_languages(segs: DataFrame) -> DataFrame:
    """Per document with running text: its language, that language's share of the words, and a confidence."""
    per = segs.groupBy("doc_id", "label", "language").agg(F.sum("words").alias("w"), F.sum(F.col("words") * F.col("confidence")).alias("m"))
    best = per.groupBy("doc_id", "label").agg(F.min_by(F.struct("w", "language", "m"), F.struct(-F.col("w"), "language")).alias("x"), F.sum("w").alias("all"))
    return best.select("doc_id", "label", F.col("x.language").alias("language"), (F.col("x.w") / F.col("all")).alias("share"), (F.col("x.m") / F.col("x.w")).alias("confidence"))


def unnamed_languages(segs: DataFrame, languages: list[str], least_sentences: int = 2) -> DataFrame:
    """(doc_id, lang): languages with a stretch of enough sentences that the document's label does not name."""
    code = F.split(F.lower(F.trim("label")), r"[-_\s]")[0]
    named = F.lit(False)
    for language in languages:
        forms = sorted({c for c in [language.lower(), *ISO, *(x for y in ISO.values() for x in y)] if same_language(c, language)})
        named = named | ((F.col("language") == language) & F.coalesce(code.isin(forms), F.lit(False)))
    return segs.where((F.col("sentences") >= least_sentences) & ~named).select("doc_id", F.col("language").alias("lang")).distinct()
