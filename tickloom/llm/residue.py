"""Template residue and error pages: positive-unlabelled naive Bayes over passages, and decisions on records."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Bounds of the sample that the classifiers are fitted on: documents at large, documents served with an error status, and
#: characters up to which a document may be drawn (all documents are scored, and whole).
SAMPLE_DOCS, SAMPLE_TRUSTED, SAMPLE_CHARS = 6000, 6000, 200_000
#: HTTP status from which a record was served as an error.
ERROR_STATUS = 400
#: Share of known words from which a passage with a slot is first taken for unfilled.
FAMILIAR = 0.8
#: Rounds of expectation-maximisation, smoothing, words of a passage that shows content.
ROUNDS, SMOOTH, CONTENT_WORDS = 12, 0.1, 8
#: Records that a word's rates are shrunk by, passages a word needs to vouch for residue, and how far one has to stand out.
SHRINK, SUPPORT, LIFT = 20, 2, 2.0
#: Feature of a passage of a few words over and over.
REPEATED = "over and over"
#: Log odds at which a passage is residue.
SURE = 0.0

#: A few passages that are residue in any corpus; the rest is learnt from records served as errors.
SEEDS = ["Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Please enable JavaScript to view this page.", "404 Not Found. The page you requested could not be found.", "500 Internal Server Error. Please try again later.", "Your text goes here."]

_NAME = r"(?:[A-Za-z]+(?:[._ ][A-Za-z]+)+|[A-Za-z]{2,})"
#: Syntaxes of template slots around a name of letters. Fixed values.
SLOT = re.compile(
    rf"\{{\{{\s*({_NAME})\s*\}}\}}|\{{%-?\s*(?:block )?({_NAME})\s*-?%\}}|[$#]\{{\s*({_NAME})\s*\}}|(?<![\w{{$#\\])\{{\s*({_NAME})\s*\}}(?!\}})|\[\[\s*({_NAME})\s*\]\]|(?<![\w\[])\[\s*({_NAME})\s*\](?![\](])"
    rf"|<%=?\s*({_NAME})\s*%>|&lt;\s*({_NAME})\s*&gt;|<({_NAME})>|\$({_NAME})\$|%\(({_NAME})\)s|%({_NAME})%|__({_NAME})__|@@({_NAME})@@|##({_NAME})##|\*\|({_NAME})\|\*"
)
_WORD = re.compile(r"[^\W\d_]+")
_RELATED = re.compile(r"^[^:/]{1,40}: [^/:]+( / [^:/]{1,40}: [^/:]+)*$")
_END = re.compile(r"[.!?…。]['\")»]?\s*$")
#: Code pages that UTF-8 is most often misread in.
_PAGES = ("cp1252", "latin-1", "cp1251", "iso8859-2", "cp1250", "iso8859-15", "koi8-r")
#: Letters that a misreading in cp1252 loses beyond repair (their bytes have no character there), and those that stand for them.
_LOST = str.maketrans("сэяЁАН", "\x81\x81\x81\x90\x90\x90")


def _repaired(text: str) -> str:
    """UTF-8 that was read in another code page, read anew where the whole passage allows it.

    Where characters were lost on the way, what the lost bytes may have been is one letter: words then still agree with
    those of other texts, which get the same letter (see features).
    """
    if text.isascii():
        return text
    for page in _PAGES:
        try:
            return text.encode(page).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
    if "�" in text and ("Ð" in text or "Ñ" in text):
        raw = b"".join(b"\x81" if c == "�" else c.encode("cp1252", "ignore") or c.encode("latin-1", "ignore") for c in text)
        return raw.decode("utf-8", "ignore").replace("Ё", "\x90")
    return text


def features(passage: str) -> list[str]:
    """Words of a passage, once each, and whether it is a few words over and over; slots are left out."""
    text = _repaired(passage)
    if not text.isascii():
        text = text.translate(_LOST).replace("\x81", "с").replace("\x90", "а")
    words = _WORD.findall(SLOT.sub(" ", text).lower())
    out = list(dict.fromkeys(words))
    if len(words) >= 6 and len(out) <= 0.3 * len(words):
        out.append(REPEATED)
    return out


def slots(passage: str) -> list[str]:
    """Names in the template slots of a passage."""
    if not any(c in passage for c in "{[<%_@#*&$"):
        return []
    return [next(filter(None, m.groups())).lower() for m in SLOT.finditer(passage)]


@dataclass
class Bayes:
    """Log ratios of words between residue and other passages, and of the classes."""

    ratio: dict[str, float]
    prior: float

    def score(self, words: list[str]) -> float:
        """Posterior log odds that a passage is residue; words never seen tell nothing."""
        return self.prior + sum(self.ratio.get(w, 0.0) for w in words)


def trusted_passages(failed: list[list[str]], others: list[list[str]], n_failed: int, n_others: int) -> np.ndarray:
    """Which passages of records served as errors are residue beyond doubt.

    Some of these records show content nevertheless, and its words are as frequent in all other records.  So each word has
    the log ratio of its rates by record, shrunk towards none, and counts for residue only if ``SUPPORT`` passages have it;
    a passage is trusted where their sum is ``LIFT`` times the root of its words or more.
    """
    vocabulary: dict[str, int] = {}
    for p in (*failed, *others):
        for w in p:
            vocabulary.setdefault(w, len(vocabulary))
    count = lambda ps: np.bincount([vocabulary[w] for p in ps for w in p], minlength=len(vocabulary)).astype(float)
    a, b = count(failed), count(others)
    usual = (a + b) * SHRINK / max(n_failed + n_others, 1)
    ratio = np.log((a + usual) / (n_failed + SHRINK)) - np.log((b + usual) / (n_others + SHRINK))
    ratio = np.where(a >= SUPPORT, ratio, np.minimum(ratio, 0.0))
    return np.array([bool(p) and ratio[[vocabulary[w] for w in p]].sum() >= LIFT * math.sqrt(len(p)) for p in failed], bool)


def fit(trusted: list[list[str]], unlabelled: list[list[str]], rounds: int = ROUNDS, smooth: float = SMOOTH, familiar: float | None = None) -> Bayes:
    """Positive-unlabelled naive Bayes by expectation-maximisation.

    Trusted passages stay residue.  Unlabelled ones begin as the other class, or with ``familiar`` only those of whose
    words less than that share occurs in trusted ones (reliable negatives); each round fits the words of both classes to
    the passages weighted by their posteriors and takes new posteriors.
    """
    vocabulary: dict[str, int] = {}
    for p in (*trusted, *unlabelled):
        for w in p:
            vocabulary.setdefault(w, len(vocabulary))
    if not vocabulary or not trusted:
        return Bayes({}, -30.0)
    v = len(vocabulary)
    at = np.array([vocabulary[w] for p in unlabelled for w in p], int)
    of = np.repeat(np.arange(len(unlabelled)), [len(p) for p in unlabelled])
    sure = np.bincount([vocabulary[w] for p in trusted for w in p], minlength=v).astype(float)
    post = np.zeros(len(unlabelled))
    if familiar is not None:
        seen = np.bincount(of, sure[at] > 1, len(unlabelled))
        post = (seen >= familiar * np.maximum(np.bincount(of, minlength=len(unlabelled)), 1)).astype(float)
    # Both classes are smoothed towards the words of all passages, in proportion to their size: a rare word, or one of a
    # rare language, then speaks for neither class by being rare.
    usual = sure + np.bincount(at, minlength=v)
    usual /= usual.sum()
    ratio, prior = np.zeros(v), 0.0
    for _ in range(rounds):
        pos = sure + np.bincount(at, post[of], v)
        neg = np.bincount(at, 1 - post[of], v)
        ratio = np.log(pos / max(pos.sum(), 1e-9) + smooth * usual) - np.log(neg / max(neg.sum(), 1e-9) + smooth * usual)
        n = len(trusted) + post.sum()
        prior = math.log(n / max(len(unlabelled) - post.sum(), 1.0))
        odds = prior + np.bincount(of, ratio[at], len(unlabelled))
        post = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return Bayes(dict(zip(vocabulary, ratio.tolist())), prior)


def is_furniture(passage: str, words: list[str]) -> bool:
    """Menus, related links, footers and other lines without a sentence; a few words over and over are none of these."""
    if REPEATED in words:
        return False
    return not _END.search(passage) or _RELATED.match(passage.rstrip(".!?")) is not None


def decide(text: str | None, residue: Bayes, template: Bayes) -> tuple[str | None, float]:
    """The kind of residue of a record, or none, and the log odds behind it.

    A record is 'template' if a passage has slots and the template classifier takes it for unfilled.  It is 'replaced' if
    at least as many sentences are residue as show content: a lead before filler doesn't make a page, nor does a notice
    beside two passages of content replace it.  Without any content lines that aren't sentences count as well.
    """
    if not text:
        return None, 0.0
    lines = [x for x in (p.strip() for p in text.split("\n")) if x]
    best = max((template.score(template_features(line, names)) for line in lines if (names := slots(line))), default=-math.inf)
    if best > SURE:
        return "template", best
    found, n_residue, n_content = -math.inf, 0, 0
    loose = -math.inf
    for line in lines:
        words = features(line)
        if not words:
            continue
        odds = residue.score(words)
        if odds <= SURE:
            n_content += not is_furniture(line, words) and len(line.split()) >= CONTENT_WORDS
        elif not is_furniture(line, words):
            found, n_residue = max(found, odds), n_residue + 1
        elif not _RELATED.match(line):
            loose = max(loose, odds)
    if not n_content:
        found = max(found, loose)
    return ("replaced", found) if found > SURE and n_residue >= n_content else (None, 0.0)


def is_placeholder(passage: str, names: list[str]) -> bool:
    """A title that is a slot, and a passage with several slots: trusted placeholder records for the fit."""
    return len(names) > 1 or (not features(passage) and names == ["title"])


def template_features(passage: str, names: list[str]) -> list[str]:
    """Words around slots; of a passage that is nothing but slots their names."""
    words = features(passage)
    return words or [f"alone:{n}" for n in dict.fromkeys(names)]


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_trusted: int = SAMPLE_TRUSTED, sample_chars: int = SAMPLE_CHARS) -> tuple[Bayes, Bayes]:
    """Classifiers of residue and of unfilled slots.

    ``docs``: doc_id, text, status (null where unknown).  Trusted are the records served with an error status, about
    ``sample_trusted`` of them, and the seeds; unlabelled are about ``sample_docs`` of the others.  A hash of the id draws
    both, among documents of at most ``sample_chars`` characters, so that the driver's share is bounded whatever the corpus.
    """
    failed = F.coalesce(F.col("status") >= ERROR_STATUS, F.lit(False))
    n_failed, n_other = docs.agg(F.count_if(failed), F.count_if(~failed)).first()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(2**32))
    share = lambda want, there: int(min(1.0, want / max(there, 1)) * 2**32)
    drawn = docs.where(F.col("text").isNotNull() & (F.length("text") <= sample_chars) & (place < F.when(failed, share(sample_trusted, n_failed)).otherwise(share(sample_docs, n_other))))
    pages = sorted(tuple(r) for r in drawn.select(F.coalesce(F.xxhash64("doc_id"), F.lit(0)), failed, "text").collect())
    plain, noisy, slotted, proven = [], [], [], []
    for _, bad, page in pages:
        for line in dict.fromkeys(page.split("\n")):
            names = slots(line)
            if names:
                (proven if is_placeholder(line, names) else slotted).append(template_features(line, names))
            elif not is_furniture(line, words := features(line)):
                (noisy if bad else plain).append(words)
    n_bad = sum(bad for _, bad, _ in pages)
    sure = trusted_passages(noisy, plain, n_bad, len(pages) - n_bad)
    trusted = [features(x) for x in SEEDS] + [p for p, ok in zip(noisy, sure) if ok]
    plain += [p for p, ok in zip(noisy, sure) if not ok]
    residue = fit(trusted, plain)
    # Passages of content stand for the words around slots as well: a slot takes the place of a word in one of them.
    content = [p for p in plain if residue.score(p) <= SURE]
    return residue, fit(proven + content, slotted, familiar=FAMILIAR)


def residue_of_records(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_trusted: int = SAMPLE_TRUSTED, status: str | None = None) -> DataFrame:
    """Kind of residue of every record: 'template', 'replaced' or null, and its log odds.

    ``docs``: doc_id, text, and ``status``, the name of the column of HTTP status codes if there is one.  Two
    positive-unlabelled naive Bayes classifiers are fitted by expectation-maximisation from trusted records; all passages
    (lines) of all texts are scored, and a record is decided from its passages (see decide), whatever its status.
    Null and empty texts have no residue; ids may be null or repeat, rows are kept.  Output: doc_id, kind, score.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast(StringType()).alias("text"), (F.col(status) if status else F.lit(None)).cast("int").alias("status"))
    residue, template = train(rows, sample_docs, sample_trusted)

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [decide(t, residue, template) for t in part["text"]]
            yield pd.DataFrame({"doc_id": part["doc_id"], "kind": pd.Series([k for k, _ in found], dtype=object), "score": [round(s, 3) for _, s in found]})

    return rows.select("doc_id", "text").mapInPandas(score, "doc_id bigint, kind string, score double")
