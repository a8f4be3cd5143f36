"""Personal data by weak supervision.

Patterns propose spans. Labelers vote on each: shape, check digits and ranges, gazetteers of names,
calling codes and top-level domains, the words before, and what stands next to the span. The votes
of all spans are counted by pattern of votes in Spark; expectation-maximisation over these counts
estimates how reliable each labeler is and how likely each pattern of votes is personal data.
With that as labels a logistic classifier of spans is trained, over the votes and the span's shape,
which decides. Spans of the base patterns stay whatever it says; it decides about the others.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graincart.llm.common import in_pandas, materialize

#: Kinds in the order in which they are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "mac", "person")
BASE = 4
_LOCAL = r"[A-Za-z0-9._%+-]"
_DOMAIN = r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_EMAIL, _EMAIL_ON = re.compile(rf"(?<!{_LOCAL}){_LOCAL}++{_DOMAIN}"), re.compile(rf"{_LOCAL}++{_DOMAIN}")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_MAC = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])")
_PERSON = re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\. [A-Z][a-z]+(?: [A-Z][a-z]+)?")
#: Gazetteers.
DOMAINS = frozenset("com org net edu gov io co uk de fr es it nl eu us info biz dev app ch at be pt pl ru jp cn in br ca au".split())
CALLING = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "7", "81", "82", "84", "86", "90", "91", "92", "93", "94", "98", "212", "351", "352", "353", "358", "380", "420", "852", "886", "966", "971", "972")
NAMES = frozenset("james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica thomas sarah charles karen anna maria peter paul hans marie pierre jean carlos jose juan ana laura sofia lucas emma".split())
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65", "22", "23", "24", "25", "26", "27", "35", "36", "38")
CUES = {
    "email": ("mail", "contact", "write", "reach", "address"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "payment", "karte", "tarjeta", "carte"),
    "phone": ("phone", "call", "tel", "mobile", "cell", "fax", "contact"),
    "ssn": ("ssn", "social", "security", "tax"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "mac": ("mac", "device", "hardware", "ethernet"),
    "person": ("name", "dear", "patient", "by", "from", "sincerely"),
}
AGAINST = ("version", "release", "order", "invoice", "isbn", "sku", "section", "build", "article", "chapter")
LABELERS = 5
_CUE = {k: re.compile(r"(?<![a-z])(?:" + "|".join(v) + ")", re.I) for k, v in CUES.items()}
_AGAINST = re.compile(r"(?<![a-z])(?:" + "|".join(AGAINST) + r")\b", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches one after another; a run of the local part is tried only where it begins."""
    at = 0
    while True:
        match = _EMAIL_ON.match(text, at) if at else None
        match = match or _EMAIL.search(text, at)
        if match is None:
            return
        yield match.span()
        at = match.end()


def _iban_valid(value: str) -> bool:
    compact = value.replace(" ", "")
    turned = compact[4:] + compact[:4]
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of all proposed spans; those of the base kinds meet the base's tests."""
    out = []
    if "@" in text:
        out += [(a, b, 0) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            out.append((*m.span(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = re.sub(r"[ -]", "", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((*m.span(), 3))
    out += [(*m.span(), 4) for m in _SSN.finditer(text)]
    out += [(*m.span(), 5) for m in _IBAN.finditer(text)]
    out += [(*m.span(), 6) for m in _MAC.finditer(text)]
    out += [(*m.span(), 7) for m in _PERSON.finditer(text)]
    return out


def votes(text: str, start: int, end: int, kind: int) -> list[int]:
    """1 for personal data, -1 against it, 0 for no opinion: check, gazetteer, words before, borders, shape."""
    value, name = text[start:end], KINDS[kind]
    digits = re.sub(r"[^0-9]", "", value)
    if name == "card":
        check, known = 1, 1 if digits.startswith(ISSUERS) else -1
    elif name == "ip":
        parts = [int(x.lstrip("0") or 0) for x in value.split(".")]
        check, known = (1 if parts[0] not in (0, 127, 255) and all(len(x) < 4 for x in value.split(".")) else -1), (-1 if parts[:2] == [192, 168] or parts[0] in (0, 10, 127) else 0)
    elif name == "email":
        check, known = (1 if not value.startswith((".", "-")) and ".." not in value else -1), 1 if value.rsplit(".", 1)[1].lower() in DOMAINS else -1
    elif name == "phone":
        check, known = (1 if len(digits) >= 10 else -1), 1 if digits.startswith(CALLING) else -1
    elif name == "ssn":
        check, known = (1 if digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000" else -1), 0
    elif name == "iban":
        check, known = (1 if _iban_valid(value) else -1), 0
    elif name == "mac":
        check, known = (-1 if len(set(digits)) <= 1 and not re.search("[A-Fa-f]", value) else 1), 0
    else:
        check, known = 0, 1 if any(w.lower() in NAMES for w in value.split()[1:]) else 0
    before = text[max(0, start - 40) : start]
    words = 1 if _CUE[name].search(before) else -1 if _AGAINST.search(before) else 0
    near = text[max(0, start - 1) : start] + text[end : end + 1]
    border = -1 if any(c.isalnum() for c in near) else 1
    shape = -1 if len(set(value)) <= 3 else 1 if len(value) <= 60 else 0
    return [check, known, words, border, shape]


def _code(vote: list[int], kind: int, size: int) -> int:
    """The votes, the kind and the binned length as one number."""
    code = 0
    for v in vote:
        code = code * 3 + v + 1
    return (code * len(KINDS) + kind) * 8 + min(size // 8, 7)


def _decode(code: int) -> tuple[list[int], int, int]:
    code, size = divmod(code, 8)
    code, kind = divmod(code, len(KINDS))
    vote = []
    for _ in range(LABELERS):
        code, v = divmod(code, 3)
        vote.append(v - 1)
    return vote[::-1], kind, size


@dataclass(frozen=True)
class Model:
    reliability: np.ndarray
    chances: dict[int, float]


def fit(counts: dict[int, int], rounds: int = 40) -> Model:
    """Reliabilities and the chance of each code from the codes' counts.

    reliability[l, y, v] is the chance that labeler l votes v (-1, 0, 1) on a span of truth y.
    """
    if not counts:
        return Model(np.full((LABELERS, 2, 3), 1 / 3), {})
    codes = sorted(counts)
    weight = np.array([counts[c] for c in codes], float)
    parts = [_decode(c) for c in codes]
    vote = np.array([p[0] for p in parts]) + 1
    # the start: more votes for than against
    chance = 1 / (1 + np.exp(-(vote - 1).sum(axis=1) - 0.5))
    for _ in range(rounds):
        both = np.stack([1 - chance, chance])
        table = np.empty((LABELERS, 2, 3))
        for lab in range(LABELERS):
            for v in range(3):
                table[lab, :, v] = (both * weight)[:, vote[:, lab] == v].sum(axis=1) + (1.5 if v == 1 else 1.0)
        # a vote is never taken for its opposite
        table[:, 1, 2] = np.maximum(table[:, 1, 2], table[:, 1, 0])
        table[:, 0, 0] = np.maximum(table[:, 0, 0], table[:, 0, 2])
        table /= table.sum(axis=2, keepdims=True)
        prior = ((both * weight).sum(axis=1) + 1) / (weight.sum() + 2)
        logs = np.log(prior)[:, None] + sum(np.log(table[lab][:, vote[:, lab]]) for lab in range(LABELERS))
        chance = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -30, 30)))
    # the span classifier: votes, kind and length, trained on what the votes say together
    x = np.zeros((len(codes), 3 * LABELERS + len(KINDS) + 8 + 1))
    for i, (v, kind, size) in enumerate(parts):
        x[i, [3 * j + a + 1 for j, a in enumerate(v)]] = 1
        x[i, 3 * LABELERS + kind] = x[i, 3 * LABELERS + len(KINDS) + size] = x[i, -1] = 1
    w = np.zeros(x.shape[1])
    share = weight / weight.sum()
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 2.0 * (x.T @ (share * (p - chance)) + 1e-4 * w)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return Model(table, dict(zip(codes, p.tolist(), strict=True)))


_SPANS = "array<struct<start:int,kind:int,end:int,code:int>>"


def _propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = []
        for text in batch["text"]:
            spans = sorted((a, kind, b) for a, b, kind in candidates(text)) if text else []
            found.append([{"start": a, "kind": k, "end": b, "code": _code(votes(text, a, b, k), k, b - a)} for a, k, b in spans])
        yield pd.DataFrame({**{c: batch[c] for c in batch.columns if c != "text"}, "spans": pd.Series(found, index=batch.index, dtype=object)})


def propose(docs: DataFrame) -> tuple[DataFrame, Model]:
    """doc_id and proposed spans of each row of ``docs``, and the model fitted on all of them."""
    found = materialize(in_pandas(docs.select("doc_id", "text"), _propose, "doc_id", f"spans {_SPANS}"))
    # there are at most 3 ** LABELERS * len(KINDS) * 8 codes, whatever the number of documents
    counts = found.select(F.explode("spans.code").alias("code")).groupBy("code").count().collect()
    return found, fit({r["code"]: r["count"] for r in counts})


def _stands(span: dict, model: Model, least: float) -> bool:
    return span["kind"] < BASE or model.chances[span["code"]] >= least


def find_personal_data(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, start, end, kind and chance of each span of ``docs`` (doc_id, text) that is personal data.

    Places are in code points, and ends exclusive. A null text counts as empty and has no spans.
    Repeated rows have equal results and count as often as they come in the estimates. Texts are
    read whole. An empty table gives an empty result. Only doc_id and text are read.
    """
    found, model = propose(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                (doc_id, s["start"], s["end"], KINDS[s["kind"]], model.chances[s["code"]])
                for doc_id, spans in zip(batch["doc_id"], batch["spans"], strict=True)
                for s in spans
                if _stands(s, model, least)
            ]
            yield pd.DataFrame(out, columns=["doc_id", "start", "end", "kind", "chance"])

    return in_pandas(found, run, "doc_id", "start int, end int, kind string, chance double")


def personal_data_digests(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans for each row of ``docs``; see ``find_personal_data``."""
    found, model = propose(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for spans in batch["spans"]:
                kept = [(f"{KINDS[s['kind']]}:{s['start']}:{s['end']}", s["kind"]) for s in spans if _stands(s, model, least)]
                base = ",".join(x for x, k in kept if k < BASE)
                n = [sum(k == i for _, k in kept) for i in range(BASE)]
                rows.append((*n, hashlib.sha256(base.encode()).hexdigest(), ",".join(x for x, _ in kept)))
            names = [*(f"n_{k}" for k in KINDS[:BASE]), "base_sha256", "spans"]
            yield pd.concat([batch[["doc_id"]], pd.DataFrame(rows, columns=names, index=batch.index)], axis=1)

    counts = ", ".join(f"n_{k} long" for k in KINDS[:BASE])
    return in_pandas(found, run, "doc_id", f"{counts}, base_sha256 string, spans string")
