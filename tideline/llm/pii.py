"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, and a span classifier decides."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.bpe import slices
from tideline.llm.common import stage

# The base kinds in their order, then the kinds that only the method finds.
BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "id", "secret")
KINDS = BASE_KINDS + MORE_KINDS

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Looser patterns: what they find is a candidate, no more.
_LOOSE = (
    ("phone", re.compile(r"(?<![\w.+-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])")),
    ("id", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?!\w)")),
    ("secret", re.compile(r"(?<![\w-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{16,}+(?![\w-])")),
)
_HIDDEN_MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++")

# Gazetteers and context words.
_DOMAIN_ENDS = frozenset("com org net edu gov io de fr es uk us eu info biz ch at it nl be".split())
_KEY_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "sk_", "pk_", "xox", "AIza", "glpat-")
_CARD_STARTS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "38")
_IBAN_COUNTRIES = frozenset("AT BE CH CZ DE DK ES FI FR GB IE IT LI LU NL NO PL PT SE".split())
_CONTEXT = {
    "email": "mail email e-mail contact write correo courriel", "ip": "ip host server address client login adresse",
    "card": "card visa credit payment karte carte tarjeta", "phone": "phone tel call fax mobile telefon tel: llamar",
    "iban": "iban account bank konto compte cuenta", "id": "ssn social security id insurance",
    "secret": "password passwd token secret key apikey api_key pwd auth credential",
}
_CONTEXT = {k: frozenset(v.split()) for k, v in _CONTEXT.items()}
_AGAINST = frozenset("version isbn issn doi order figure section page chapter license commit revision build".split())
_WORDS = re.compile(r"[\w-]+")

LABELERS = ("pattern", "check", "gazetteer", "context", "setting")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base rules, by kind and then start: leftmost matches without overlap within a kind; failing ones are dropped."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def more_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates beside the base spans: leftmost first, the longer of two at one place, none that touches another span."""
    found = []
    if "(at)" in text or "[at]" in text:
        found += [("email", *m.span()) for m in _HIDDEN_MAIL.finditer(text)]
    if _DIGIT.search(text):
        for kind, pattern in _LOOSE:
            found += [(kind, *m.span()) for m in pattern.finditer(text)]
    if not found:
        return []
    taken = sorted((i, j) for _, i, j in base)
    out, end, k = [], -1, 0
    for kind, i, j in sorted(found, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        while k < len(taken) and taken[k][1] <= i:
            k += 1
        if i >= end and not any(a < j and b > i for a, b in taken[k:k + 8]):
            out.append((kind, i, j))
            end = j
    return out


def votes(text: str, kind: str, i: int, j: int) -> tuple[int, ...]:
    """One vote of each labeler: 2 personal, 1 not, 0 no opinion."""
    span = text[i:j]
    digits = "".join(c for c in span if "0" <= c <= "9")
    before = set(_WORDS.findall(text[max(0, i - 40):i].lower()))
    around = text[i - 1:i] + text[j:j + 1]
    pattern = check = gazetteer = 0
    if kind == "email":
        end = re.split(r"[.)\] ]", span)[-1].lower()
        pattern = 2 if "@" in span else 0
        check = 2 if end.isalpha() and 2 <= len(end) <= 12 else 1
        gazetteer = 2 if end in _DOMAIN_ENDS else 0
    elif kind == "ip":
        parts = span.split(".")
        pattern = 2 if all(p == str(int(p)) for p in parts) else 1
        check = 1 if int(parts[0]) in (0, 255) else 2
        gazetteer = 1 if span in ("127.0.0.1", "0.0.0.0", "255.255.255.255") or all(len(p) == 1 for p in parts) else 0
    elif kind == "card":
        pattern = 2 if len(digits) in (15, 16) else 0
        check = 2 if luhn(digits) else 1
        gazetteer = 2 if digits.startswith(_CARD_STARTS) else 1
    elif kind == "phone":
        pattern = 2 if span.startswith("+") or re.fullmatch(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", span) else 0
        check = 2 if 9 <= len(digits) <= 15 else 1
        gazetteer = 2 if span[:2] in ("+1", "+3", "+4", "+5", "+6", "+7", "+8", "+9", "+2") else 0
    elif kind == "iban":
        moved = span[4:] + span[:4]
        pattern = 2 if 15 <= len(span) <= 34 else 1
        check = 2 if int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 else 1
        gazetteer = 2 if span[:2] in _IBAN_COUNTRIES else 1
    elif kind == "id":
        pattern = 2
        check = 1 if span[:3] in ("000", "666") or span[4:6] == "00" or span[7:] == "0000" else 2
    else:
        pattern = 2 if re.fullmatch(r"[0-9a-f]{16,}|[A-Z0-9]{20}|[A-Za-z0-9_-]{24,}", span) else 0
        flips = sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:]))
        check = 2 if flips >= len(span) / 5 else 1
        gazetteer = 2 if span.startswith(_KEY_STARTS) else 0
    context = 2 if before & _CONTEXT[kind] else 1 if before & _AGAINST else 0
    setting = 1 if any(c.isalnum() or c in "_/\\" for c in around) else 2 if all(c in " \n\t\"'()<>,;=" for c in around) else 0
    return pattern, check, gazetteer, context, setting


def _shape(text: str, kind: str, i: int, j: int) -> tuple[int, ...]:
    """Features of the final classifier: kind, length, share of digits, separators, letters of both cases, neighbours, context."""
    span = text[i:j]
    digits = sum("0" <= c <= "9" for c in span)
    side = [2 if not c or c.isspace() else 1 if not c.isalnum() else 0 for c in (text[i - 1:i] if i else "", text[j:j + 1])]
    return (KINDS.index(kind), int(np.digitize(j - i, (9, 13, 17, 24, 36))), int(np.digitize(digits / (j - i), (0.2, 0.5, 0.75, 0.999))),
            int(any(c in " .-()" for c in span)), int(any(c.isupper() for c in span)) + 2 * int(any(c.islower() for c in span)), *side,
            int(any(w in _CONTEXT[kind] for w in _WORDS.findall(text[max(0, i - 40):i].lower()))))


_SIZES = (len(KINDS), 6, 5, 2, 4, 3, 3, 2)


def _pack(values: tuple[int, ...], sizes: tuple[int, ...]) -> int:
    code = 0
    for v, n in zip(values, sizes, strict=True):
        code = code * n + v
    return code


def _unpack(code: int, sizes: tuple[int, ...]) -> list[int]:
    out = []
    for n in reversed(sizes):
        code, v = divmod(code, n)
        out.append(v)
    return out[::-1]


_VOTE_SIZES = (len(KINDS), *[3] * len(LABELERS))
_SPAN = "struct<kind:string,start:int,end:int,base:boolean,votes:int,shape:int>"


def annotate(text: str) -> list[dict]:
    """All base spans and candidates of a text with their votes and shapes."""
    base = base_spans(text)
    return [{"kind": k, "start": i, "end": j, "base": b, "votes": _pack((KINDS.index(k), *votes(text, k, i, j)), _VOTE_SIZES),
             "shape": _pack(_shape(text, k, i, j), _SIZES)}
            for spans, b in ((base, True), (more_spans(text, base), False)) for k, i, j in spans]


def reliabilities(patterns: dict[int, int], rounds: int = 60) -> dict[int, float]:
    """Expectation-maximisation on the numbers of candidates by (kind, votes): the probability of personal data for each.

    Every labeler has, for true and for false spans, its own distribution over its three votes; every kind has its own prior.
    The start trusts the majority, counts are smoothed. The table has at most len(KINDS) * 3 ** len(LABELERS) rows.
    """
    codes = sorted(patterns)
    if not codes:
        return {}
    n = np.array([patterns[c] for c in codes], float)
    table = np.array([_unpack(c, _VOTE_SIZES) for c in codes])
    kind, vote = table[:, 0], table[:, 1:]
    balance = (vote == 2).sum(axis=1) - 1.0 * (vote == 1).sum(axis=1)
    p = 1 / (1 + np.exp(-balance))
    for _ in range(rounds):
        prior = np.array([(p * n)[kind == k].sum() + 1 for k in range(len(KINDS))]) / (np.array([n[kind == k].sum() for k in range(len(KINDS))]) + 2)
        odds = np.log(prior[kind] / (1 - prior[kind]))
        for labeler in range(vote.shape[1]):
            for v in range(3):
                hit = vote[:, labeler] == v
                true = ((p * n)[hit].sum() + (3 if v == 2 else 1)) / ((p * n).sum() + 5)
                false = (((1 - p) * n)[hit].sum() + (3 if v == 1 else 1)) / (((1 - p) * n).sum() + 5)
                odds[hit] += np.log(true / false)
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return dict(zip(codes, p.tolist(), strict=True))


def classifier(shapes: list[tuple[int, float, float]], rounds: int = 30, ridge: float = 1.0) -> dict[int, float]:
    """Logistic regression by Newton steps on (shape, candidates, expected personal ones): the probability of every shape met."""
    if not shapes:
        return {}
    starts = np.cumsum([0, *_SIZES[:-1]])
    x = np.zeros((len(shapes), sum(_SIZES) + 1))
    for row, (code, _, _) in enumerate(shapes):
        x[row, starts + np.array(_unpack(code, _SIZES))] = 1
    x[:, -1] = 1
    n, y = np.array([s[1] for s in shapes], float), np.array([s[2] for s in shapes], float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - n * p) - ridge * w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
    return {s[0]: float(v) for s, v in zip(shapes, 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), strict=True)}


def annotated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, spans`` for every row, from its whole text."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        import pyarrow as pa

        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32()), ("shape", pa.int32())])
        for whole in batches:
            for batch in slices(whole, 1):
                found = [annotate(t or "") for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_pydict({"id": batch.column(0), "spans": pa.array(found, pa.list_(span))})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, spans array<{_SPAN}>")


def accepted_shapes(found: DataFrame, least: float = 0.5) -> list[int]:
    """Fit the labelers and the classifier on all candidates of ``found`` and return the shapes that it takes for personal data.

    The driver only sees counts by vote pattern and by shape; both tables have a fixed greatest size.
    """
    spans = found.select(F.explode("spans").alias("s")).select("s.votes", "s.shape")
    cells = spans.groupBy("votes", "shape").count().collect()
    patterns: dict[int, int] = {}
    for c in cells:
        patterns[c["votes"]] = patterns.get(c["votes"], 0) + c["count"]
    likely = reliabilities(patterns)
    shapes: dict[int, list[float]] = {}
    for c in cells:
        s = shapes.setdefault(c["shape"], [0.0, 0.0])
        s[0] += c["count"]
        s[1] += c["count"] * likely[c["votes"]]
    probability = classifier([(k, *v) for k, v in sorted(shapes.items())])
    return sorted(k for k, p in probability.items() if p >= least)


def _joined(spans):
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(order, s["kind"]).alias("o"), s["start"].alias("i"), s["end"].alias("j"), s["kind"].alias("k"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["k"], s["i"], s["j"])), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Personal data of every row: numbers of base spans, digest of the base spans, and all spans.

    Spans are kind:start:end in code points with an exclusive end. Base spans always count; candidates of the looser patterns
    count if the trained classifier gives their shape ``least`` or more. A null text has no spans, nor has an empty one; rows
    are judged one by one, so ties, repeated rows and null ids need no rule; an empty table gives no rows; other columns are
    ignored.
    """
    found = stage(annotated(docs, id_col, text_col), "spans")
    taken = F.array(*[F.lit(s) for s in accepted_shapes(found, least)]).cast("array<int>")
    base = F.filter("spans", lambda s: s["base"])
    spans = F.filter("spans", lambda s: s["base"] | F.array_contains(taken, s["shape"]))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint").alias(f"n_{kind}")

    return found.select(F.col("id").alias(id_col), *map(count, BASE_KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def mask_spans(text: str, spans) -> str:
    """``text`` with every (start, end, kind) replaced by its kind in angle brackets; of overlapping ones the first counts, then the longest."""
    out, at = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
            at = end
        elif end > at:
            at = end
    return "".join(out) + text[at:]


def masked(text: str, taken: frozenset[int]) -> str:
    """``text`` with its base spans and the candidates of the shapes ``taken`` masked."""
    return mask_spans(text, [(s["start"], s["end"], s["kind"]) for s in annotate(text) if s["base"] or s["shape"] in taken])


#: Name of the column that holds the spans between the two passes of :func:`redact`.
_HELD = "__tideline_spans"


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with personal data in ``text_col`` masked.

    Texts are annotated once, whole, and written with their spans; fitting reads the spans, masking both. Null texts stay null,
    empty ones empty, and all other columns stay as they are whatever their names (only ``__tideline_spans`` is taken); ties,
    repeated rows and null ids need no rule, as rows are masked one by one; an empty table gives none.
    """
    @F.pandas_udf(f"array<{_SPAN}>")
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([annotate(t or "") for t in texts], dtype=object)

    text = F.col(text_col).cast("string")
    held = stage(docs.withColumn(_HELD, spans(text)), "redact_spans")
    taken = F.array(*[F.lit(s) for s in accepted_shapes(held.select(F.col(_HELD).alias("spans")), least)]).cast("array<int>")
    kept = F.transform(F.filter(_HELD, lambda s: s["base"] | F.array_contains(taken, s["shape"])), lambda s: F.struct(s["start"], s["end"], s["kind"]))

    @F.pandas_udf("string")
    def mask(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or not len(f) else mask_spans(t, [tuple(x.values()) for x in f]) for t, f in zip(texts, found, strict=True)], dtype=object)

    return held.withColumn(text_col, mask(text, kept)).drop(_HELD)
