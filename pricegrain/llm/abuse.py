"""Problem 10: abusive, hateful or sexual remarks, by compression distance to two dictionaries."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread

# --- fixed values: letters that look alike, and figures and signs written for letters ---
ALIKE = str.maketrans("аеорсухівкмнтԁһјӏѕԛԝɡοαειυνρτκχß", "aeopcyxibkmhtdhjlsqwgoaeiuvptkxs")
LEET = str.maketrans("4310578$@€", "aeiostbsae")
# --- end of fixed values ---

_L = r"[^\W\d_]"  # a letter
_MARK = regex.compile(r"[\p{Mn}\p{Cf}\p{Me}]+")
_SPACED = re.compile(rf"(?<!\w)(?:{_L}[ .\-_*·]){{2,}}{_L}(?!\w)")
_GAP = re.compile(r"[ .\-_*·]")
_BANG = re.compile(rf"(?<=[^\W_])!(?={_L})")
_DOT = re.compile(rf"(?<={_L})[._*·](?={_L})")
_SIGN = re.compile(r"[\d$@€]")
_UNIT = re.compile(r"\d+(?:[.,]\d+)*")
_TOUCHED = re.compile(rf"{_L}[\d$@€]|[\d$@€]{_L}")
_LEETED = re.compile(rf"[\w$@€]*(?:{_L}[\d$@€]|[$@€\d]{_L})[\w$@€]*")
_TWICE = re.compile(rf"({_L})\1+")
_REST = re.compile(r"(?:(?!0)[\W\d_])+")
_BREAK = re.compile(r"(?<=[.!?…])[\"'»)]*\s+|[\r\n]+|(?<=[.!?…]{2})\s*")
_FIGURE = re.compile(r"(?<![^\W_])(?<![$@€.,])\d+(?:[.,]\d+)*(?![^\W_])(?![$@€])")


def normalise(text: str) -> str:
    """One spelling for many: no accents, case, look-alikes, drawn-out or spaced letters; every figure is 0."""
    text = text.lower()
    if not text.isascii():
        text = _MARK.sub("", unicodedata.normalize("NFKD", text)).lower().translate(ALIKE)
    text = _SPACED.sub(lambda m: _GAP.sub("", m[0]), text)
    if "!" in text:
        text = _BANG.sub("i", text)
    text = _DOT.sub("", text)
    if _SIGN.search(text):

        def figure(m: re.Match) -> str:
            before = text[m.start() - 1 : m.start()]
            written_as_letter = (before and (before.isalpha() or before in "$@")) or text[m.end() : m.end() + 1].isalpha()
            return m[0] if written_as_letter else "0"

        text = _UNIT.sub(figure, text)
        if _TOUCHED.search(text):
            text = _LEETED.sub(lambda m: m[0].translate(LEET), text)
    return _REST.sub(" ", _TWICE.sub(r"\1", text)).strip()


#: Words of a window, and from one window to the next inside a sentence longer than the first number and the half of it.
WORDS, STEP = 8, 4
#: A window of fewer bytes is read together with the next one of its text, or the one before.
LEAST_BYTES = 8


def _of_sentence(sentence: str) -> list[str]:
    words = normalise(sentence).split()
    if len(words) <= WORDS + STEP // 2:
        return [" ".join(words)] if words else []
    return [" ".join(words[i : i + WORDS]) for i in range(0, len(words) - WORDS + STEP, STEP)]


def windows(text: str, known: dict | None = None) -> list[str]:
    """Normalised windows of a whole text: its sentences, long ones in overlapping stretches of WORDS words.

    Sentences that differ in their figures only are normalised once, if `known` (sentence -> windows) is handed on.
    """
    known = {} if known is None else known
    out: list[str] = []
    short = ""
    for sentence in _BREAK.split(text):
        if sentence and not sentence.isspace():
            sentence = _FIGURE.sub("0", sentence)
            found = known.get(sentence)
            if found is None:
                own = _of_sentence(sentence)
                found = known[sentence] = (own, any(len(w.encode()) < LEAST_BYTES for w in own))
            own, has_short = found
            if not short and not has_short:
                out += own
                continue
            for w in own:
                w = f"{short} {w}" if short else w
                short = w if len(w.encode()) < LEAST_BYTES else ""
                if not short:
                    out.append(w)
    if short:
        out[-1:] = [f"{out[-1]} {short}" if out else short]
    return out


@dataclass(frozen=True)
class AbuseRules:
    """Bounds: at most `sample` judged documents of `characters` in all train the dictionaries; sizes of these in bytes."""

    sample: int = 6_000
    characters: int = 64_000_000
    toxic_bytes: int = 112_640
    ordinary_bytes: int = 2_097_152
    level: int = 19
    rounds: int = 3
    folds: int = 3
    margin: float = 0.15  # least score of a toxic window in training
    flat: float = 0.005  # F1 that separates the cuts taken for equal
    height: float = 0.65  # where in their range the threshold is taken
    prior: tuple[float, float] = (0.45, 5.0)  # a cautious threshold, and how many abusive texts it counts as
    rare: float = 0.0006  # words in at most this share of the texts are mostly names
    support: float = 0.003  # share of the abusive texts a word must be in to speak against a window


@dataclass
class AbuseModel:
    toxic: bytes
    ordinary: bytes
    threshold: float
    level: int = 19
    sizes: dict = field(default_factory=dict)


def _compressor(content: bytes, level: int):
    """A compressor that begins with the dictionary; matches of three bytes, for windows are short."""
    import zstandard

    if len(content) < 8:
        return zstandard.ZstdCompressor(level=level, write_content_size=False)
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters(
        compression_level=level, window_log=max(18, len(content).bit_length()), hash_log=17, chain_log=17, search_log=6, min_match=3, target_length=64,
        strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    known.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=params)


def dictionary(samples: list[str], size: int) -> bytes:
    """The content of a dictionary: the distinct windows that fit, the most frequent last, where matches are cheapest.

    What the windows are is learnt in `fit`; the library's own selection of segments from them was tried and finds
    fewer remarks (README).
    """
    counted = [w for w, _ in sorted(Counter(samples).items(), key=lambda x: (x[1], x[0]))]
    return ("\n" + "\n".join(counted) + "\n").encode()[-size:] if counted else b""


def scorer(model: AbuseModel):
    """window -> bytes by which the toxic dictionary shortens it more than the ordinary one, over its length (24 to 40)."""
    toxic, ordinary = _compressor(model.toxic, model.level), _compressor(model.ordinary, model.level)

    def score(window: str) -> float:
        raw = f"\n{window}\n".encode()
        # a remark may be a part of its window only, so the length counts up to a short remark's
        return (len(ordinary.compress(raw)) - len(toxic.compress(raw))) / min(max(len(raw) - 2, 24), 40)

    return score


def fit(texts: list[str], abusive: list[bool], rules: AbuseRules = AbuseRules()) -> AbuseModel:
    """Dictionaries and threshold from judged texts of which some judgements are wrong.

    A window starts as toxic if it is more frequent per document in abusive texts and its words lean to them
    (log odds over documents, by words with enough support), as ordinary if it is from another text and its words
    do not lean. In each round both dictionaries are trained; windows of abusive texts whose words lean and that
    the toxic one shortens more join it, and those it no longer shortens leave; windows of other texts that it
    shortens more are misjudged and leave the ordinary one. The threshold is among those with nearly
    the best F1 over all documents, each scored by dictionaries trained without it (cross-validation), drawn to a
    cautious prior that counts as a few abusive texts; the last training is on all.
    """
    known: dict = {}
    split = [windows(t, known) for t in texts]

    def train(chosen: list[int]) -> AbuseModel:
        words = [({x for w in split[i] for x in w.split()}) for i in chosen]
        bad, good = max(1, sum(abusive[i] for i in chosen)), max(1, sum(not abusive[i] for i in chosen))
        word_bad = Counter(x for i, own in zip(chosen, words, strict=True) if abusive[i] for x in own)
        word_good = Counter(x for i, own in zip(chosen, words, strict=True) if not abusive[i] for x in own)
        rare = max(2, math.ceil(rules.rare * len(chosen)))
        # rare words are mostly names: windows that differ in them only count together
        mask = lambda w: " ".join(x if word_bad[x] + word_good[x] >= rare else "_" for x in w.split())
        in_bad: Counter = Counter()
        in_good: Counter = Counter()
        spelt: dict[str, Counter] = {}
        for i in chosen:
            for w in sorted(set(split[i])):
                t = mask(w)
                (in_bad if abusive[i] else in_good)[t] += 1
                spelt.setdefault(t, Counter())[w] += 1
        least = max(2, math.ceil(rules.support * bad))
        odds = {x: math.log((n + 0.5) / (bad + 1) * (good + 1) / (word_good[x] + 0.5)) for x, n in word_bad.items() if n >= least}
        lean = {}
        for t in spelt:
            known = [x for x in t.split() if x != "_"]
            lean[t] = sum(o for x in known if (o := odds.get(x, 0.0)) > 2.3) / max(3, len(known))
        frequent = {t for t, n in in_bad.items() if n / bad > 6 * in_good[t] / good}
        toxic = {t for t in frequent if lean[t] > 0.5}
        ordinary = {t for t in in_good if t not in toxic and lean[t] <= 0.5}
        model = AbuseModel(b"", b"", rules.margin, rules.level)
        for _ in range(rules.rounds):
            model = AbuseModel(
                dictionary([w for t in toxic for w, n in spelt[t].items() for _ in range(min(n, 20))], rules.toxic_bytes),
                dictionary([w for t in ordinary for w, _ in spelt[t].most_common(2) for _ in range(min(in_good[t] or 1, 20))], rules.ordinary_bytes),
                rules.margin, rules.level,
            )
            of = scorer(model)
            drawn = {t for t in spelt if of(spelt[t].most_common(1)[0][0]) > rules.margin}
            # where the words' evidence and the compression agree a window joins or leaves; what lies between goes into neither
            toxic = {t for t in toxic if t in drawn} | {t for t in frequent if lean[t] > 0.25 and t in drawn}
            ordinary = {t for t in spelt if t not in toxic and (lean[t] <= 0.25 or lean[t] <= 0.5 and t not in drawn) and (in_good[t] or t not in drawn)}
        return model

    top, total = [], sum(abusive)
    for fold in range(rules.folds):
        rest = [i for i in range(len(texts)) if i % rules.folds != fold]
        if any(abusive[i] for i in rest):
            score = scorer(train(rest))
            top += [(max((score(w) for w in split[i]), default=-1.0), abusive[i]) for i in range(fold, len(texts), rules.folds)]
    top.sort(reverse=True)
    hit, cuts = 0, []
    for k, (s, bad) in enumerate(top, 1):
        hit += bad
        following = top[k][0] if k < len(top) else s
        if s != following or k == len(top):
            cuts.append((2 * hit / (k + total), (s + following) / 2))
    model = train(list(range(len(texts))))
    # F1 is flat around its best; judged documents are richer in abuse than others, so the cut is above the middle of that range
    flat = [cut for f1, cut in cuts if f1 >= max(cuts)[0] - rules.flat] or [0.0]
    best = min(flat) + rules.height * (max(flat) - min(flat))
    cautious, weight = rules.prior
    model.threshold = (total * max(best, 0.0) + weight * cautious) / (total + weight)
    return model


def judged(documents: DataFrame, labels: DataFrame, rules: AbuseRules = AbuseRules()) -> pd.DataFrame:
    """text, abusive of at most `sample` judged documents, by hash of doc_id; most votes win, a tie and unsure are left out."""
    votes = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.count_if(F.col("verdict") == "abusive").alias("bad"), F.count_if(F.col("verdict") == "ok").alias("good"))
    votes = votes.filter("bad != good")
    known = documents.filter("text is not null").select("doc_id", "text").join(votes, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rules.sample)
    upto = F.sum(F.length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", "text"))  # over the sample only
    return known.withColumn("upto", upto).filter(F.col("upto") <= rules.characters).select("text", (F.col("bad") > F.col("good")).alias("abusive")).toPandas()


def score_documents(documents: DataFrame, labels: DataFrame, rules: AbuseRules = AbuseRules()) -> DataFrame:
    """(doc_id, source, score, window, is_abusive) of every document; window is its worst one, normalised.

    Empty, blank and null texts have score null and are not abusive; so is every text where no document was
    judged abusive. Whole texts are read, window by window.
    """
    train = judged(documents, labels, rules)
    model = fit(train["text"].tolist(), train["abusive"].tolist(), rules)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = scorer(model)
        for batch in batches:
            known, scores, best = {}, {}, []  # sentences and windows that come again in a batch are read once
            for text in batch["text"]:
                own = windows(text or "", known)
                for w in own:
                    if w not in scores:
                        scores[w] = of(w)
                best.append(max(((scores[w], w) for w in own), default=(None, None)))
            frame = batch[["doc_id", "source"]].copy()
            frame["score"] = pd.array([b[0] for b in best], dtype="Float64")
            frame["window"] = [b[1] for b in best]
            frame["is_abusive"] = [b[0] is not None and bool(model.toxic) and b[0] > model.threshold for b in best]
            yield frame

    rows = spread(documents.select("doc_id", "source", "text"))
    return rows.mapInPandas(score, "doc_id long, source string, score double, window string, is_abusive boolean")


def rates(scored: DataFrame) -> DataFrame:
    """source, documents, abusive, rate; a null source is a source of its own."""
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if("is_abusive").alias("abusive"), F.avg(F.col("is_abusive").cast("int")).alias("rate")
    )
