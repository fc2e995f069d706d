"""Personal data by weak supervision.

Candidate spans come from strict patterns (the base spans) and looser ones.
Five labelers vote on every candidate: +1 personal data, -1 not, 0 no opinion
(strict format, gazetteer, context words, isolation, variety of characters).
The votes of all documents are counted by pattern: at most 3**5 patterns a
kind, whatever the size of the corpus.  Expectation-maximisation over these
counts estimates how reliable each labeler is for each kind, and a logistic
regression on the votes, fitted to the posteriors, is the final span
classifier.  Base spans are always reported; a looser candidate is reported
if the classifier gives it at least ``threshold``.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import map_rows
from .staging import load, stage

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("format", "gazetteer", "context", "isolation", "variety")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

LOOSE_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:"
    r"\s?(?:\(at\)|\[at\]|\{at\}|@)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\(dot\)|\[dot\]|\{dot\}|\bdot\b|\.)\s?[A-Za-z0-9-]{1,63}){1,5}"
    r"|\sat\s[A-Za-z0-9-]{1,63}(?:\sdot\s[A-Za-z0-9-]{1,63}){1,5})"
)
LOOSE_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9])")
LOOSE_PHONE = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\)[\x20.-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")

# Words before a span that speak for a kind, and against any.
CONTEXT = {
    "email": ("mail", "contact", "write", "e-mail", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "login", "client"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "telefon", "móvil"),
}
AGAINST = ("version", "isbn", "issn", "order", "invoice", "serial", "build", "release", "section", "chapter")
# Top-level domains, calling codes and leading card digits taken as known.
DOMAINS = frozenset("com org net edu gov mil int info biz io co me dev app de fr es it uk us ca au nl ch at be eu jp cn in br ru se no fi dk pl pt".split())
CALLING = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "60", "61", "62", "63", "64", "65", "66", "7", "81", "82", "84", "86", "90", "91", "92", "94", "351", "352", "353", "358", "420", "971")
ISSUERS = ("4", "51", "52", "53", "54", "55", "2221", "23", "24", "25", "26", "270", "271", "2720", "34", "37", "6011", "65", "62", "35", "36")


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = sum(map(int, number[-1::-2])) + sum(sum(divmod(2 * int(c), 10)) for c in number[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 16 <= len(number := digits(m[0])) <= 19 and luhn(number):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return found


def loose_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates beside the base spans; none overlaps a base span."""
    low, found = text.lower(), []
    if "@" in text or "(at)" in low or "[at]" in low or "{at}" in low or " dot " in low:
        found += [("email", *m.span()) for m in LOOSE_EMAIL.finditer(text)]
    if "[.]" in text or "(.)" in text:
        found += [("ip", *m.span()) for m in LOOSE_IP.finditer(text)]
    for m in CARD.finditer(text):
        if 13 <= len(number := digits(m[0])) <= 15 and luhn(number):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in LOOSE_PHONE.finditer(text)]
    if not found:
        return []
    taken = bytearray(len(text))
    for _, start, end in base:
        taken[start:end] = b"\1" * (end - start)
    out: list[tuple[str, int, int]] = []
    for kind, start, end in found:
        if 1 not in taken[start:end]:
            out.append((kind, start, end))
            taken[start:end] = b"\1" * (end - start)
    return out


def votes(text: str, kind: str, start: int, end: int, strict: bool) -> tuple[int, ...]:
    """The labelers' votes, in the order of LABELERS."""
    span, number = text[start:end], digits(text[start:end])
    before = text[max(0, start - 40) : start].lower()
    if kind == "email":
        known = span.rsplit(".", 1)[-1].lower().strip(")]} ") in DOMAINS
        variety = not re.match(r"(?i)(no-?reply|example|test|user|name)[^a-z0-9]", span)
    elif kind == "ip":
        first = int(re.match("[0-9]+", span)[0][-4:])
        known = 0 < first < 224 and first not in (10, 127)
        variety = len(set(number)) > 1
    elif kind == "card":
        known = number.startswith(ISSUERS)
        variety = len(set(number)) >= 4
    else:
        known = number.startswith(CALLING) if span[0] == "+" else number[0] not in "01"
        variety = len(set(number)) >= 3
    words = set(re.findall(r"\w[\w-]*", before))
    context = 1 if words.intersection(CONTEXT[kind]) else -1 if words.intersection(AGAINST) else 0
    beside = text[max(0, start - 1) : start], text[end : end + 1]
    isolated = not any(c.isalnum() or c == "_" for c in beside)
    return (1 if strict else 0, 1 if known else -1, context, 1 if isolated else -1, 1 if variety else -1)


def candidates(text: str) -> list[tuple[str, int, int, bool, str]]:
    """(kind, start, end, base, votes) by kind, then start; votes: one of -0+ for each labeler."""
    if not re.search("[0-9@]|(?i:[({]at|\\[at)| dot ", text):
        return []
    base = base_spans(text)
    both = [(*x, True) for x in base] + [(*x, False) for x in loose_spans(text, base)]
    both.sort(key=lambda x: (KINDS.index(x[0]), x[1]))
    return [(*x, "".join("-0+"[v + 1] for v in votes(text, *x))) for x in both]


def estimate(counts: list[tuple[str, str, int]], rounds: int = 100) -> dict[tuple[str, str], float]:
    """Posterior of each (kind, votes) by expectation-maximisation; counts: (kind, votes, number)."""
    out = {}
    for kind in KINDS:
        rows = sorted((v, n) for k, v, n in counts if k == kind)
        if not rows:
            continue
        cast = np.array([["-0+".index(c) for c in v] for v, _ in rows])
        n = np.array([n for _, n in rows], float)
        post = 1 / (1 + np.exp(-(cast - 1).sum(1)))  # to begin with, every labeler counts alike
        for _ in range(rounds):
            log = np.zeros((2, len(rows)))
            for z, weight in ((0, n * (1 - post)), (1, n * post)):
                log[z] += np.log(weight.sum() + 1) - np.log(n.sum() + 2)
                for labeler in range(cast.shape[1]):
                    # Priors: a labeler is right rather than wrong.
                    seen = np.bincount(cast[:, labeler], weight, 3) + (np.array([1.0, 1.0, 4.0]) if z else np.array([4.0, 1.0, 1.0]))
                    log[z] += np.log(seen / seen.sum())[cast[:, labeler]]
            post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -30, 30)))
        out |= {(kind, v): float(p) for (v, _), p in zip(rows, post, strict=True)}
    return out


def features(kind: str, vote: str) -> np.ndarray:
    """Kind, and each labeler's +1 and -1 votes within the kind."""
    x = np.zeros(len(KINDS) * (1 + 2 * len(LABELERS)))
    at = KINDS.index(kind) * (1 + 2 * len(LABELERS))
    x[at] = 1
    for i, c in enumerate(vote):
        if c != "0":
            x[at + 1 + 2 * i + (c == "+")] = 1
    return x


def train(counts: list[tuple[str, str, int]], posterior: dict[tuple[str, str], float], ridge: float = 0.1) -> np.ndarray:
    """Weights of a logistic regression on the votes, by Newton's method."""
    x = np.array([features(k, v) for k, v, _ in counts]).reshape(len(counts), len(KINDS) * (1 + 2 * len(LABELERS)))
    y = np.array([posterior[k, v] for k, v, _ in counts])
    n = np.sqrt(np.array([c for *_, c in counts], float))  # so that rare patterns count, too
    w = np.zeros(len(KINDS) * (1 + 2 * len(LABELERS)))
    for _ in range(25 if len(counts) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = x.T @ (x * (n * p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (n * (y - p)) - ridge * w)
    return w


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``doc_id, spans``: personal data of every text by kind, then start.

    Offsets are code points, end exclusive; ``base`` tells the strict spans,
    ``score`` is the classifier's probability.  A null text counts as empty, an
    empty text gives an empty array, repeated rows give repeated results, an
    empty table an empty result; other columns are ignored.
    """

    def each(doc_id, text):
        yield doc_id, [dict(zip(("kind", "start", "end", "base", "votes"), x, strict=True)) for x in candidates(text or "")]

    id_type = docs.schema[id_col].dataType.simpleString()
    kind = "array<struct<kind:string,start:long,end:long,base:boolean,votes:string>>"
    found = stage(map_rows(docs.select(id_col, text_col), each, f"doc_id {id_type}, found {kind}"), "candidates")
    patterns = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes").count()
    counts = sorted(tuple(r) for r in patterns.collect())  # at most 4 * 3**5 rows
    w = train(counts, estimate(counts))
    scores = {f"{k}{v}": float(1 / (1 + np.exp(-features(k, v) @ w))) for k, v, _ in counts} or {"": 0.0}
    table = F.map_from_arrays(F.lit(list(scores)), F.lit(list(scores.values())))
    scored = F.transform(
        "found",
        lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"), F.element_at(table, F.concat(c["kind"], c["votes"])).alias("score")),
    )
    return found.select("doc_id", F.filter(scored, lambda c: c["base"] | (c["score"] >= threshold)).alias("spans"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(load(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op3_personal_data": op3_personal_data}
ORACLE: dict[str, str] = {}
