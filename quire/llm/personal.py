"""PII: fixed patterns, then a semi-Markov conditional random field.

The patterns find e-mail addresses, IP addresses, payment cards and phone numbers in the whole text.  A
semi-Markov CRF then adds what has another form: it scores whole candidate spans (shape, digit count, check
digits, octets, groups of hexadecimal digits, randomness, words before) for every kind, and dynamic programming over spans of bounded
length chooses boundaries and kinds jointly.  Kinds of its own are secrets, bank accounts, numbers of persons and dates of birth.  It looks
at the neighbourhoods of digits, at-signs and spelt-out addresses only, as a span without them is no candidate.  Pattern spans stay; spans of the
model that overlap one are dropped.

The model is trained here, on the driver, on sentences made from a fixed seed (EXAMPLES of them, which
bounds it); weights of a few kB go to the tasks.  One scan, no shuffle.

Defined results: a null text is empty and has no spans; offsets are code points, ends exclusive; texts of any
length are searched whole, in time proportional to their length; repeated rows give equal rows; empty
tables give no rows; extra columns are ignored; a null id is an id like any other; equal scores go to the shorter way from the left.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "account", "person_number", "birth_date")
Span = tuple[str, int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches: a local part is the run of its characters before an at-sign, back to the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield "email", start, done
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[Span]:
    """Of each chain of numbers with dots between, four at a time."""
    for m in DOTTED.finditer(text):
        parts, start = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield "ip", start, end
            start = end + 1


def patterns(text: str) -> list[Span]:
    """The base spans, by kind as listed and then start."""
    out = list(emails(text)) if "@" in text else []
    if DIGIT.search(text):
        if "." in text:
            out += addresses(text)
        for m in DIGITS.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdecimal() and c.isascii() for c in m.group()) <= 15]
    return out


# ---- the semi-Markov model

LONGEST = 16  # units in a span
REACH = 64  # code points around a digit or at-sign
FEATURES = 1 << 12
EXAMPLES, EPOCHS, RATE = 1800, 6, 0.5
UNIT = re.compile(r"[^\W_]+|[^\s]")
HOT = re.compile(r"[0-9@]|[(\[] ?[aA][tT] ?[)\]]|\b[aA][tT] (?=\w+ [dD][oO][tT]\b)|AKIA(?=[A-Z0-9]{12})")
COLLAPSE = re.compile(r"9+|a+|\s+")
HINTS = {
    **dict.fromkeys("token key secret password passwd pwd passphrase apikey api bearer auth credential".split(), "secret"),
    **dict.fromkeys("iban account bank transfer".split(), "account"),
    **dict.fromkeys("ssn social passport licence license national taxpayer".split(), "person"),
    **dict.fromkeys("born birth birthday dob birthdate".split(), "birth"),
    **dict.fromkeys("phone tel telephone mobile call fax cell".split(), "phone"),
    **dict.fromkeys("card visa credit mastercard pan".split(), "card"),
    **dict.fromkeys("mail email contact write".split(), "email"),
    **dict.fromkeys("ip host server address".split(), "ip"),
    **dict.fromkeys("version page no order year figure isbn id item invoice".split(), "number"),
}
SHAPE = {**{ord(d): "9" for d in "0123456789"}, **{c: "a" for c in (*range(65, 91), *range(97, 123))}}


@lru_cache(65536)
def feature(name: str) -> int:
    return crc32(name.encode()) % FEATURES


def regions(text: str) -> list[tuple[int, int]]:
    """Neighbourhoods of digits and at-signs, widened to white space and merged."""
    out: list[list[int]] = []
    end = -1
    for m in HOT.finditer(text):
        if m.start() < end - REACH // 2:
            continue
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        while a > 0 and m.start() - a < 4 * REACH and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and b - m.end() < 4 * REACH and not text[b].isspace():
            b += 1
        if out and a <= out[-1][1]:
            out[-1][1] = end = max(b, out[-1][1])
        else:
            out.append([a, b])
            end = b
    return [(a, b) for a, b in out]


def candidates(text: str, units: list[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
    """(first unit, unit after the last, features) of the spans that the model may choose."""
    out = []
    words = [text[a:b] for a, b in units]
    hot = [bool(HOT.search(w)) for w in words]
    lowered = [w.lower() for w in words]
    for i, (start, _) in enumerate(units):
        if not (words[i][0].isalnum() or words[i][0] in "+("):
            continue
        hints = {HINTS[w] for w in lowered[max(0, i - 4) : i] if w in HINTS}
        before = text[start - 1] if start else " "
        warm = False
        for j in range(i, min(i + LONGEST, len(units))):
            end = units[j][1]
            if j > i and (end - start > 4 * REACH or (units[j][0] > units[j - 1][1] and text[units[j - 1][1] : units[j][0]] != " ")):
                break
            warm = warm or hot[j] or lowered[j] == "at"
            if not warm or not words[j][-1].isalnum():
                continue
            span = text[start:end]
            after = text[end : end + 2] + "  "
            digits = "".join(c for c in span if "0" <= c <= "9")
            shape = span.translate(SHAPE)
            short = COLLAPSE.sub(lambda m: m.group()[0], shape)
            names = ["bias", f"shape={short[:40]}", f"digits={min(len(digits), 22)}", f"units={j + 1 - i}"]
            names += [f"hint={h}" for h in hints] or ["hint=none"]
            if 13 <= len(digits) <= 19 and shape.strip("9 -") == "":
                names.append(f"luhn={luhn(digits)}")
            if short == "9.9.9.9":
                names.append(f"octets={all(int(p) <= 255 for p in span.split('.') if len(p) < 6)}")
            if span.count(":") > 1 and HEXES.fullmatch(span):
                groups = span.split(":")
                names.append(f"hex={len(groups)},{'' in groups},{max(map(len, groups)) > 2}")
            if 15 <= len(span) <= 42 and ACCOUNT.fullmatch(span):
                names.append(f"iban={iban(span)}")
            if i == j and digits and len(digits) < len(span):
                names += [f"mixed+hint={h},{min(len(span) // 4, 3)}" for h in hints or ["none"]]
                names.append(f"caps={span.isupper()},{min(len(span) // 8, 3)}")
            if SPELT.fullmatch(span):
                names.append(f"spelt,{i > 0 and lowered[i - 1] == 'dot'},{j + 1 < len(units) and lowered[j + 1] == 'dot'}")
            if len(span) < 32:
                names += [f"shape+hint={short[:20]},{h}" for h in hints or ["none"]]
            if i == j and len(span) >= 16:
                mixed = 0 < len(digits) < len(span)
                names += [f"long={min(len(span) // 8, 6)},{mixed}", f"random={mixed and len(set(span)) >= 8}"]
                names += [f"long+hint={h},{mixed}" for h in hints]
            if before.isalnum() or before in "+@._-":
                names.append(f"glued-left={before if not before.isalnum() else 'a'}")
            if after[0].isalnum() or (after[0] in "@._-+" and after[1].isalnum()):
                names.append(f"glued-right={after[0] if not after[0].isalnum() else 'a'}")
            out.append((i, j + 1, [feature(n) for n in names]))
    return out


HEXES = re.compile(r"[0-9a-fA-F]{1,4}(?::{1,2}[0-9a-fA-F]{1,4})+")
SPELT = re.compile(r"(?i)\w+(?: dot \w+)* at \w+(?: dot \w+)+")
ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4})+")


def iban(text: str) -> bool:
    """Whether the check digits of an account number are right."""
    plain = text.replace(" ", "")
    return len(plain) >= 15 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def scores(weights: np.ndarray, spans: list[tuple[int, int, list[int]]]) -> np.ndarray:
    flat = np.concatenate([f for _, _, f in spans])
    starts = np.cumsum([0, *(len(f) for _, _, f in spans[:-1])])
    return np.add.reduceat(weights[flat], starts)


def best(n: int, spans: list[tuple[int, int, list[int]]], score: np.ndarray) -> list[tuple[int, int, int]]:
    """The segmentation of n units with the highest score: (first unit, unit after the last, kind) of its spans."""
    kinds, tops = score.argmax(1), score.max(1)
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    for s, (_, j, _) in enumerate(spans):
        if tops[s] > 0:
            ending[j].append(s)
    value, came = [0.0] * (n + 1), [-1] * (n + 1)
    for j in range(1, n + 1):
        value[j] = value[j - 1]
        for s in ending[j]:
            if (v := value[spans[s][0]] + tops[s]) > value[j]:
                value[j], came[j] = v, s
    out, j = [], n
    while j > 0:
        if (s := came[j]) < 0:
            j -= 1
        else:
            out.append((spans[s][0], j, int(kinds[s])))
            j = spans[s][0]
    return out[::-1]


def marginals(n: int, spans: list[tuple[int, int, list[int]]], score: np.ndarray) -> np.ndarray:
    """Probability of each (span, kind) under the model; units outside spans score 0."""
    whole = np.logaddexp.reduce(score, axis=1)
    ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    starting: list[list[int]] = [[] for _ in range(n + 1)]
    for s, (i, j, _) in enumerate(spans):
        ending[j].append(s)
        starting[i].append(s)
    for j in range(1, n + 1):
        ahead[j] = float(np.logaddexp.reduce([ahead[j - 1], *(ahead[spans[s][0]] + whole[s] for s in ending[j])]))
    for i in range(n - 1, -1, -1):
        behind[i] = float(np.logaddexp.reduce([behind[i + 1], *(behind[spans[s][1]] + whole[s] for s in starting[i])]))
    outside = np.array([ahead[i] + behind[j] for i, j, _ in spans]) - ahead[n]
    return np.exp(np.minimum(0.0, score + outside[:, None]))


def example(rng: random.Random) -> tuple[str, list[Span]]:
    """A made sentence with its true spans."""
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))

    def card() -> str:
        body = rng.choice("3456") + num(14)
        digits = next(body + d for d in "0123456789" if luhn(body + d))
        return rng.choice(["", " ", "-", "."]).join(digits[k : k + 4] for k in range(0, 16, 4))

    def wrong() -> str:
        body = num(15)
        return next(body + d for d in "0123456789" if not luhn(body + d))

    def account() -> str:
        country, body = rng.choice(["DE", "FR", "GB", "NL", "ES", "CH"]), rng.choice([num(18), num(14), "".join(rng.choice("ABCDEFGH") for _ in range(4)) + num(14), num(10) + rng.choice("MNPQ") + num(12)])
        check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97
        plain = f"{country}{check:02d}{body}"
        return rng.choice([plain, " ".join(plain[k : k + 4] for k in range(0, len(plain), 4))])

    octets = lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))
    capital = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
    group = lambda: rng.choice([hexes(4), "0000", hexes(3), hexes(4)])
    six = lambda: rng.choice([":".join(group() for _ in range(8)), f"{hexes(4)}:{hexes(3)}::{hexes(4)}", f"fe80::{hexes(4)}:{hexes(4)}:{hexes(4)}", f"2001:db8:{hexes(4)}::{rng.randint(1, 9)}"])
    spelt = lambda: f"{word()}{rng.choice([f' dot {word()}', ''])} at {word()} dot {rng.choice(['com', 'org', 'net'])}"
    clock = lambda: f"{rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}"
    day = lambda: rng.choice([f"19{num(2)}-0{rng.randint(1, 9)}-1{num(1)}", f"{rng.randint(1, 28):02d}/{rng.randint(1, 12):02d}/19{num(2)}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.19{num(2)}", f"20{num(2)}-1{rng.randint(0, 2)}-0{rng.randint(1, 9)}"])
    weak = lambda: rng.choice([word() + num(rng.randint(1, 4)), f"{word().capitalize()}{num(2)}{word()}", f"{word()}{num(1)}{capital(2)}", num(1) + word() + num(3)])
    made = rng.choice(["email", "ip", "card", "phone", "secret", "secret", "account", "person_number", "birth_date", "none", "none", "none", "none"])
    kind, lead, value = {
        "email": lambda: ("email", rng.choice(["mail ", "contact ", "write to ", ""]), rng.choice([f"{word()}.{word()}{num(2)}@{word()}.example.{rng.choice(['com', 'org'])}", f"{word()} (at) {word()}.com", f"{word()} [at] {word()}.org", f"{word()}@{word()}.net", spelt()])),
        "ip": lambda: ("ip", rng.choice(["host ", "from ", "server ", ""]), rng.choice([octets(), six()])),
        "card": lambda: ("card", rng.choice(["card ", "visa ", ""]), card()),
        "phone": lambda: ("phone", rng.choice(["call ", "tel ", "phone: ", ""]), rng.choice([f"+1 ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(3)} {num(3)}", f"{num(3)}.{num(3)}.{num(4)}"])),
        "secret": lambda: ("secret", *rng.choice([(rng.choice(['token = "', "api key: ", "password=", 'secret = "']), rng.choice([hexes(40), hexes(32), mixed(32), mixed(24)])), (rng.choice(["password: ", "passwd=", "pwd = ", "password is "]), weak()), (rng.choice(["api_key=", "key: "]), f"{rng.choice(['sk', 'rk', 'pk'])}_{rng.choice(['live', 'test'])}_{mixed(24)}"), (rng.choice(["access key ", "key id: ", ""]), f"AKIA{''.join(rng.choice('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') for _ in range(16))}")])),
        "account": lambda: ("account", rng.choice(["iban ", "account: ", "transfer to ", ""]), account()),
        "person_number": lambda: ("person_number", *rng.choice([(rng.choice(["ssn ", "ssn: ", "social security number ", "SSN is "]), f"{num(3)}-{num(2)}-{num(4)}"), (rng.choice(["passport ", "passport no. ", "passport number "]), rng.choice([capital(1) + num(8), capital(2) + num(7), num(9)]))])),
        "birth_date": lambda: ("birth_date", rng.choice(["born ", "born on ", "date of birth: ", "dob ", "birthday is "]), day()),
        "none": lambda: ("", rng.choice(["page ", "version ", "in ", "order no ", "", "$", "at ", "on ", "item "]), rng.choice([num(1), num(2), num(4), num(5), f"{num(1)}.{num(1)}.{num(1)}", f"{num(1)},{num(3)}.{num(2)}", day(), clock(), f"{clock()}:{num(2)}", f"{capital(2)}{num(4)}", f"{capital(3)}-{num(3)}", f"@{word()}", wrong(), f"{num(3)}.{num(3)}.{rng.randint(256, 999)}.{num(3)}", f"{num(10)}", f"{word()}{num(3)}", f"{num(3)} {word()} {num(4)}", f"{word()} at {word()} {num(2)}"])),
    }[made]()
    left = " ".join(word() for _ in range(rng.randint(0, 6)))
    right = " ".join(word() for _ in range(rng.randint(0, 6)))
    close = '"' if lead.endswith('"') else rng.choice(["", "", ".", ",", " |"])
    head = f"{left} {lead}" if left else lead
    text = f"{head}{value}{close} {right}".rstrip()
    return text, [(kind, len(head), len(head) + len(value))] if kind else []


@lru_cache
def train(seed: int = 7) -> np.ndarray:
    """Weights (features, kinds): maximum likelihood by stochastic gradient steps with per-weight rates."""
    rng = random.Random(seed)
    sentences = []
    for _ in range(EXAMPLES):
        text, truth = example(rng)
        units = [m.span() for m in UNIT.finditer(text)]
        spans = candidates(text, units)
        if not spans:
            continue
        gold = np.zeros((len(spans), len(KINDS)))
        for kind, a, b in truth:
            for s, (i, j, _) in enumerate(spans):
                if (units[i][0], units[j - 1][1]) == (a, b):
                    gold[s, KINDS.index(kind)] = 1
        flat = np.concatenate([f for _, _, f in spans])
        sentences.append((len(units), spans, gold, flat, np.repeat(np.arange(len(spans)), [len(f) for _, _, f in spans])))
    weights, seen = np.full((FEATURES, len(KINDS)), -0.05), np.full((FEATURES, len(KINDS)), 1e-2)
    for _ in range(EPOCHS):
        rng.shuffle(sentences)
        for n, spans, gold, flat, owner in sentences:
            slope = (gold - marginals(n, spans, scores(weights, spans)))[owner]
            change = np.zeros_like(weights)
            np.add.at(change, flat, slope)
            rows = np.unique(flat)
            seen[rows] += change[rows] ** 2
            weights[rows] += RATE * change[rows] / np.sqrt(seen[rows]) - 1e-4 * weights[rows]
    return weights.astype(np.float32)


def model_spans(text: str, weights: np.ndarray) -> list[Span]:
    """What the model finds in a whole text."""
    out = []
    for a, b in regions(text):
        units = [(a + m.start(), a + m.end()) for m in UNIT.finditer(text[a:b])]
        spans = candidates(text, units)
        if spans:
            out += [(KINDS[k], units[i][0], units[j - 1][1]) for i, j, k in best(len(units), spans, scores(weights, spans))]
    return out


def merged(base: list[Span], added: list[Span]) -> list[Span]:
    """Base spans and those added that overlap none of them, by kind as listed and then start."""
    taken = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken])
    tops = np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0, int)
    free = [s for s in added if not ((k := int(np.searchsorted(starts, s[2]))) and tops[k - 1] > s[1])]
    return sorted([*base, *free], key=lambda s: (KINDS.index(s[0]), s[1]))


SPANS = "array<struct<kind: string, start: long, stop: long>>"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans) of every document: the pattern spans, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(train())
    kind = docs.schema[id_col].dataType.simpleString()
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                base = [patterns(t) if t else [] for t in part.column(1).to_pylist()]
                full = [merged(b, model_spans(t, shared.value)) if t else [] for b, t in zip(base, part.column(1).to_pylist(), strict=True)]
                lists = [pa.array([[dict(zip(("kind", "start", "stop"), s, strict=True)) for s in x] for x in spans], struct) for spans in (base, full)]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], [id_col, "base", "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, base {SPANS}, spans {SPANS}")


def listed(spans: Column) -> Column:
    """kind:start:stop of each span, with commas between."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base spans by kind, their hash, all spans as text, how many the model added, and all spans by kind."""
    def count(kind: str, spans: str, name: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"{name}_{kind}")

    counts = [count(k, "base", "n") for k in BASE_KINDS]
    every = [F.size("spans").cast("long").alias("n_spans"), *[count(k, "spans", "all") for k in KINDS]]
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return found.select(id_col, *counts, F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), added, *every)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with each span's text replaced by its kind in angle brackets; of overlapping spans the first counts."""
    shared = docs.sparkSession.sparkContext.broadcast(train())
    at = docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        out, done = [], 0
        for kind, a, b in sorted(merged(patterns(text), model_spans(text, shared.value)), key=lambda s: s[1]) if text else ():
            if a >= done:
                out += [text[done:a], f"<{kind}>"]
                done = b
        return "".join([*out, text[done:]]) if text else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cleaned = pa.array([clean(t) for t in batch.column(at).to_pylist()], pa.string())
            yield batch.set_column(at, batch.schema.field(at).name, cleaned)

    return docs.mapInArrow(run, docs.schema)
