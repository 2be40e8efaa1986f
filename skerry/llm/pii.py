"""Personal data by weak supervision: labelers vote, EM weighs them, and a span classifier learns from the weighed votes."""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.llm import textkit as tk
from skerry.llm.store import written

KINDS = ("email", "ip", "card", "phone", "id", "secret")
BASE_KINDS = KINDS[:4]

#: The contract's patterns (here so written that no text takes more than linear time), and looser shapes.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?[\[(]at[\])] ?| at )[A-Za-z0-9-]{1,63}(?:(?: ?[\[(]dot[\])] ?| dot )[A-Za-z0-9-]{2,63}){1,4}"),
    "card": re.compile(r"(?<![A-Za-z0-9_.-])(?:(?:[0-9]{4}[ -]){3}[0-9]{1,7}|[0-9]{13,19})(?![A-Za-z0-9_-]|\.[0-9])"),
    "phone": re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9.-])"),
    "id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z0-9_/+=-]{12})[A-Za-z0-9_/+=-]++"),
}
_SECRET_CHARS = 512  # a longer run is data, not a key

#: Words that announce personal data, by kind, and words and signs that deny it.
ANNOUNCES = {
    "email": {"email", "e-mail", "mail", "contact", "correo", "courriel", "kontakt", "write", "reach", "address"},
    "ip": {"ip", "host", "server", "address", "from", "client", "peer"},
    "card": {"card", "visa", "mastercard", "credit", "debit", "karte", "carte", "tarjeta", "kreditkarte", "amex"},
    "phone": {"phone", "tel", "call", "fax", "mobile", "cell", "telefon", "telefono", "fon", "appelez", "ring", "dial", "text", "whatsapp"},
    "id": {"ssn", "social", "security", "taxpayer", "tin", "sin", "id"},
    "secret": {"token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "key", "access_key", "auth", "bearer", "credential", "credentials", "private_key"},
}
DENIES = {"version", "v", "release", "section", "isbn", "issn", "doi", "page", "no.", "figure", "table", "order", "invoice", "part", "sku", "model", "case", "commit", "sha", "sha1", "sha256", "md5", "checksum", "hash", "digest", "build", "revision", "rev", "uuid", "id=", "item", "batch", "lot"}
#: What stands inside spans that are real, and inside ones that are not; issuers' leading digits; units after numbers.
TLDS = {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "ch", "at", "it", "nl"}
KEY_HEADS = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "sk-", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "eyJ", "AIza", "SG.")
MOCK = ("xxxx", "0000", "1234567", "abcdef1234", "placeholder", "changeme", "your", "dummy", "sample")
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38")
UNITS = {"%", "€", "$", "£", "kg", "km", "mm", "cm", "ms", "px", "mb", "gb", "units", "pieces", "pages", "rows"}
LABELERS = ("shape", "gazetteer", "before", "after", "randomness")
#: Spans that the classifier learns from at most (all spans take part in EM), and the buckets of its features.
SAMPLE_SPANS, FEATURES = 20_000, 1 << 13


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        # the last label may be cut at a dot without a label after it; the pattern does so by itself
        if m:
            yield a, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """Base spans, and loose shapes that overlap none of them nor one another; the flag marks base spans.

    A key may hold digits that make a base span of their own: it is a candidate if it holds the whole of them.
    """
    base = base_spans(text)
    out = [(*s, True) for s in base]
    taken: list[tuple[int, int]] = []  # disjoint, in order
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(taken[-1][1], b))
        else:
            taken.append((a, b))
    for kind, shape in _LOOSE.items():
        for m in shape.finditer(text):
            a, b = m.span()
            if kind == "secret" and (b - a > _SECRET_CHARS or not _keylike(m[0])):
                continue
            k = bisect.bisect(taken, (a, a))
            k -= k > 0 and taken[k - 1][1] > a
            upto = k
            while upto < len(taken) and taken[upto][0] < b:
                upto += 1
            if upto == k or kind == "secret" and a <= taken[k][0] and taken[upto - 1][1] <= b:
                out.append((kind, a, b, False))
                taken[k:upto] = [(a, b)]
    return out


def _keylike(span: str) -> bool:
    return any(c.isdigit() for c in span) and any(c.isalpha() for c in span)


def _surroundings(text: str, a: int, b: int) -> tuple[list[str], str, str]:
    """Up to three words before a span, lower-cased and without signs; the signs right before it; and the word after it."""
    before = text[max(0, a - 60) : a].lower()
    tokens = [w.strip("\"'`:=,;()[]<>{}|*#&$%!?") for w in before.split()]
    after = text[b : b + 24].lower().split()
    return [w for w in tokens if w][-3:], before[-3:].strip(), after[0] if after else ""


def _entropy(span: str) -> float:
    n = len(span)
    return -sum(c / n * math.log2(c / n) for c in Counter(span).values())


def _shape_vote(kind: str, span: str, digits: str, base: bool) -> int:
    """The structure that a real value of the kind has, whatever stands around it."""
    if kind in BASE_KINDS and base:
        return 1
    if kind == "email":
        return 1 if "[" in span or "(" in span else 0
    if kind == "card":
        return 1 if luhn(digits) else -1
    if kind == "phone":
        area = digits[:3]
        return -1 if area[0] in "01" or digits[3] == "1" and digits[4] == "1" else 1 if span[0] == "(" else 0
    if kind == "id":
        return -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    # a bare hexadecimal number may as well be a digest, so its shape says nothing
    return 1 if re.fullmatch(r"[A-Z0-9]{20}|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[A-Za-z0-9+/_-]{32,}={0,2}", span) else -1 if re.fullmatch(r"[A-Za-z]+[-_][A-Za-z-_]*[0-9]{1,4}", span) else 0


def _gazetteer_vote(kind: str, span: str, digits: str) -> int:
    """Listed parts of values: domains, issuers, heads of keys; and listed mock values."""
    low = span.lower()
    if any(m in low for m in MOCK) or kind == "phone" and digits[-7:-2] == "55501":
        return -1
    if kind == "email":
        last = re.split(r"[^a-z0-9]+", low)[-1]
        return 1 if last in TLDS else 0 if len(last) == 2 else -1
    if kind == "card":
        return 1 if ISSUERS.match(digits) else -1
    if kind == "secret":
        return 1 if span.startswith(KEY_HEADS) else 0
    return 0


def _random_vote(kind: str, span: str, digits: str) -> int:
    """Values are drawn at random: few distinct characters, or runs up or down, say that this one isn't."""
    if kind == "secret":
        e = _entropy(span)
        return 1 if e >= 3.2 and sum(c.isdigit() for c in span) >= 3 else -1 if e < 2.6 else 0
    if len(digits) < 6:
        return 0
    steps = {(ord(y) - ord(x)) % 10 for x, y in zip(digits, digits[1:], strict=False)}
    return -1 if len(set(digits)) <= 2 or len(steps) == 1 else 0


def votes(text: str, kind: str, a: int, b: int, base: bool) -> tuple[int, ...]:
    """What each labeler says of a span: 1 personal, -1 not, 0 abstains. No two labelers look at the same characters in the same way."""
    span = text[a:b]
    digits = re.sub("[^0-9]", "", span)
    before, sign, after = _surroundings(text, a, b)
    announced = any(w in ANNOUNCES[kind] or any(part in ANNOUNCES[kind] for part in re.split("[^a-z]+", w)) for w in before)
    denied = any(w in DENIES for w in before[-2:]) or sign[-1:] in ("#", "$", "€") and kind != "secret"
    unit = after.strip(".,;:)\"'") in UNITS or after[:1] in ("%", "€")
    return (_shape_vote(kind, span, digits, base), _gazetteer_vote(kind, span, digits), -1 if denied else 1 if announced else 0, -1 if unit else 0, _random_vote(kind, span, digits))


def features(text: str, kind: str, a: int, b: int) -> list[int]:
    """Hashed features of a span and its surroundings, all told apart by kind: what the classifier sees, votes aside."""
    span = text[a:b]
    classes = "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in span)
    runs = re.sub(r"(.)\1*", lambda m: m[1] + ("" if len(m[0]) == 1 else str(min(len(m[0]), 9))), classes)
    before, sign, after = _surroundings(text, a, b)
    said = [
        "kind", f"length {min(len(span), 64) // 4}", f"shape {runs[:32]}", f"classes {''.join(sorted(set(classes)))}", f"variety {min(9, int(2 * _entropy(span)))}",
        f"head {span[:1]}", f"sign {sign}", f"after {after[:1] if after[:1].isalnum() else after[:2]}", *(f"word {w}" for w in before[-2:]), f"last {before[-1] if before else ''}",
    ]
    return [zlib.crc32(f"{kind} {x}".encode()) % FEATURES for x in said]


def code(kind: str, vote: tuple[int, ...]) -> int:
    """Kind and votes as one number below 6 * 3 ** 5: all that EM sees of a span."""
    n = KINDS.index(kind)
    for v in vote:
        n = 3 * n + v + 1
    return n


def decode(n: int) -> tuple[str, tuple[int, ...]]:
    vote = []
    for _ in LABELERS:
        n, v = divmod(n, 3)
        vote.append(v - 1)
    return KINDS[n], tuple(reversed(vote))


@dataclass(frozen=True)
class Model:
    #: By kind and labeler: how often it says so of personal data, and how often it denies what isn't.
    reliabilities: dict[tuple[str, str], tuple[float, float]]
    weights: np.ndarray

    def accepts(self, found: list[int]) -> bool:
        """The classifier's decision on a span's features."""
        return float(self.weights[found].sum()) > 0


#: How often labelers are expected to vote -1, 0 and 1 of what isn't personal data and of what is; and this table's weight beside the counts'.
_PRIOR, _TRUST = np.array([[0.35, 0.60, 0.05], [0.05, 0.60, 0.35]]), 0.3


def aggregate(counts: dict[int, int], rounds: int = 60) -> tuple[dict[int, float], dict[tuple[str, str], tuple[float, float]]]:
    """Each code's probability of personal data, and the labelers' reliabilities, by EM over all spans' votes (Dawid and Skene 1979).

    Each kind has its own prior and each labeler its own 2 x 3 table of how it votes given the truth of that kind; votes are
    independent given the truth, and an abstention is no evidence. The tables are shrunk towards _PRIOR, which tells EM which side is which: a labeler that
    errs often loses its say, but its denials never become praise.
    """
    belief, reliabilities = {}, {}
    for kind in KINDS:
        codes = sorted(c for c in counts if decode(c)[0] == kind)
        if not codes:
            continue
        n = np.array([counts[c] for c in codes], float)
        v = np.array([decode(c)[1] for c in codes])
        says = np.stack([v == x for x in (-1, 0, 1)], axis=2).astype(float)  # codes x labelers x votes
        q = 1 / (1 + np.exp(0.5 - 1.5 * v.sum(axis=1)))
        for _ in range(rounds):
            weight = np.stack([n * (1 - q), n * q])
            table = np.einsum("yc,clv->ylv", weight, says) + (_TRUST * weight.sum(axis=1) + 10)[:, None, None] * _PRIOR[:, None, :]
            table /= table.sum(axis=2, keepdims=True)
            share = (weight.sum(axis=1) + 2) / (n.sum() + 4)
            says_so = np.log(table)
            gap = says_so[1] - says_so[0]
            gap = np.stack([np.minimum(gap[:, 0], 0), 0 * gap[:, 1], np.maximum(gap[:, 2], 0)], axis=1)
            score = np.stack([np.full(len(n), math.log(share[0])), math.log(share[1]) + np.einsum("clv,lv->c", says, gap)])
            q = 1 / (1 + np.exp(np.clip(score[0] - score[1], -60, 60)))
        belief |= dict(zip(codes, q.tolist(), strict=True))
        seen = np.einsum("yc,clv->ylv", np.stack([n * (1 - q), n * q]), says) / np.maximum(1e-9, np.stack([n * (1 - q), n * q]).sum(axis=1))[:, None, None]
        reliabilities |= {(kind, name): (float(seen[1, k, 2]), float(seen[0, k, 0])) for k, name in enumerate(LABELERS)}
    return belief, reliabilities


def train(counts: dict[int, int], sample: list[tuple[int, list[int], int]], steps: int = 300, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """EM over counts of all codes, then logistic regression from spans' features to EM's beliefs.

    sample: (code, features, how many) of spans; rates adapt by feature, so that rare words learn as fast as common shapes.
    """
    belief, reliabilities = aggregate(counts)
    weights = np.zeros(FEATURES)
    if sample:
        width = max(len(f) for _, f, _ in sample)
        x = np.array([f + [f[0]] * (width - len(f)) for _, f, _ in sample])  # the kind's own feature fills short rows
        y = np.array([belief[c] for c, *_ in sample])
        n = np.array([m for *_, m in sample], float)
        share, seen = n / n.sum(), np.full(FEATURES, 1e-8)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(weights[x].sum(axis=1), -30, 30)))
            slope = np.bincount(x.ravel(), np.repeat(share * (p - y), width), FEATURES) + decay * weights * (seen > 1e-8) / max(1, len(sample))
            seen += slope * slope
            weights -= rate * slope / np.sqrt(seen)
    return Model(reliabilities, weights)


def _suspects(texts: pa.Array) -> np.ndarray:
    """Rows that can hold a span at all: every shape has a digit or spells out an address's `at`."""
    return np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, r"[0-9@]|\bat\b.{1,80}\bdot\b"), False).to_numpy(zero_copy_only=False))


def fit(docs: DataFrame, sample: int = SAMPLE_SPANS) -> Model:
    """EM over the votes on all spans of all documents; the classifier learns from a sample, by hash, of the distinct spans as it sees them.

    Of spans, their votes and hashed features leave the tasks, never their texts; to the driver come a number for each of some 1,458
    codes at most, and the sample.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.chunks(batches, "text"):
            seen: Counter[tuple[int, tuple[int, ...]]] = Counter()
            for k in _suspects(batch.column(0)):
                text = batch.column(0)[int(k)].as_py()
                for kind, a, b, base in candidates(text):
                    seen[code(kind, votes(text, kind, a, b, base)), tuple(features(text, kind, a, b))] += 1
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in seen], pa.int32()), pa.array([list(f) for _, f in seen], pa.list_(pa.int32())), pa.array(list(seen.values()), pa.int64())], ["code", "features", "n"])

    spans = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "code int, features array<int>, n long")
    found = written(spans.groupBy("code", "features").agg(F.sum("n").alias("n")), "spans")
    counts = {r["code"]: r["n"] for r in found.groupBy("code").agg(F.sum("n").alias("n")).collect()}
    # a rare kind's spans are learned as well: the sample is shared among the kinds
    by_kind = found.withColumn("kind", F.floor(F.col("code") / 3 ** len(LABELERS)).cast("int"))
    each = -(-sample // len(KINDS))
    rows = []
    for k in range(len(KINDS)):
        rows += by_kind.where(F.col("kind") == k).orderBy(F.xxhash64("code", "features"), "code", "features").limit(each).collect()
    return train(counts, [(r["code"], list(r["features"]), r["n"]) for r in rows])


def annotate(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Each row's spans: struct columns `own` (all columns of docs) and `spans` (kind, start, end, base).

    Start and end count code points, end exclusive; spans are ordered by kind, then start. Base spans always stay; a loose
    shape is a span if the classifier takes it. Null and empty texts have none. Whole texts are read, however long, by linear-time patterns.
    Without a model, one is fitted on docs. Repeated rows are rows of their own; a doc_id plays no part; clashing names can't meet, as
    docs' columns stay in `own`; an empty table gives an empty one.
    """
    model = model or fit(docs)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col("text").cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = held.value
        for batch in tk.chunks(batches, "text"):
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            for k in _suspects(batch.column(1)):
                text = batch.column(1)[int(k)].as_py()
                found = [s for s in candidates(text) if s[3] or judge.accepts(features(text, *s[:3]))]
                found.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
                spans[k] = [dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind_of)], ["own", "spans"])

    return own.mapInArrow(run, T.StructType([own.schema["own"], T.StructField("spans", T._parse_datatype_string("array<struct<kind:string,start:int,end:int,base:boolean>>"))]))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans' number by kind and digest, all spans as text, and their number."""
    found = annotate(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, _is(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("own.doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def redacted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with every span of `text` replaced by its kind in angle brackets; a span that overlaps an earlier one goes with it."""
    found = annotate(docs, model)
    zero = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def put(state: Column, s: Column) -> Column:
        clean = F.substr(F.col("own.text"), state["at"] + 1, F.greatest(F.lit(0), s["start"] - state["at"]))
        mark = F.when(s["start"] >= state["at"], F.concat(clean, F.lit("<"), s["kind"], F.lit(">"))).otherwise(F.lit(""))
        return F.struct(F.concat(state["text"], mark).alias("text"), F.greatest(state["at"], s["end"]).alias("at"))

    def end(state: Column) -> Column:
        return F.concat(state["text"], F.substr(F.col("own.text"), state["at"] + 1))

    text = F.when(F.size("spans") > 0, F.aggregate(ordered, zero, put, end)).otherwise(F.col("own.text"))
    return found.select(*[text.alias(c) if c == "text" else F.col(f"own.`{c}`") for c in docs.columns])
