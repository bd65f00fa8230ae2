"""PII surrogates: every detected entity gets a keyed replacement of its own kind and shape.

Kinds are e-mail addresses, phone numbers, IPv4 addresses, card numbers (Luhn-valid), social security numbers, IBANs (mod-97-valid) and names after a form of
address.  A surrogate is drawn from an HMAC of the kind and the normalised value, so the same entity gets the same one in every document
(coreference), while its writing follows the mention: separators, capitals, grouping and digits (of any script) stay.  Names keep gender and script,
card numbers stay Luhn-valid, IBANs mod-97-valid, addresses stay routable, e-mail domains become reserved ones.

Distinctness is checked over the corpus: where two entities draw the same surrogate, or one that is an entity itself, all but the
smallest draw again, until none collide.  Names and e-mail addresses, whose first shapes are few, grow by a part with each new draw, and numbers by a digit
from the ninth draw on, when nearly all of their shape must be in use: so there always is a free one.

The key is the caller's: whoever knows it can tell which number a surrogate stands for.

A null text has no entities and stays null; repeated rows are replaced alike; overlapping detections keep the earliest, then the longest;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import materialise, slices, small

KINDS = ("email", "phone", "ip", "card", "ssn", "iban", "name")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_FEMALE = "Mrs|Ms|Miss|Frau|Mme|Mlle|Madame|Señora|Sra|Госпожа|г-жа"
_MALE = "Mr|Herr|Monsieur|Señor|Sr|Господин|г-н"
PATTERNS = {
    "email": re.compile(r"(?<![\w.%+-])[\w.%+-]*\w@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "card": re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"),
    "ip": re.compile(rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)"),
    "ssn": re.compile(r"(?<![\w-])(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])"),
    "phone": re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w-])|(?<![\w+])\+\d{8,15}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]\d{2,4}){2,5}(?!\w)"),
    "name": re.compile(rf"(?<!\w)(?:(?P<f>{_FEMALE})|(?P<m>{_MALE}))\.? (?P<v>[^\W\d_a-zа-яß-ÿ][^\W\d_]+(?: [^\W\d_a-zа-яß-ÿ][^\W\d_]+)?)(?!\w)"),
}
#: Parts that surrogate names are made of, by script and gender (given names) and by script (syllables of family names).
GIVEN = {
    ("latin", "f"): "Anna Clara Diana Elena Flora Greta Helen Irene Julia Laura Maria Nora Paula Rosa Sofia Vera".split(),
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Oscar Paul Victor".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Иван Олег Павел".split(),
}
FAMILY = {"latin": "bal den for gar hol kin lan mar nor pel ran sel tor van wel zan".split(), "cyrillic": "бал вар гор дан зор кал лан мор нов пал рог сам тор хан чер шев".split()}


def ascii_digits(text: str) -> str:
    """``text`` with the decimal digits of all scripts as 0-9; no place changes."""
    if text.isascii():
        return text
    odd = {ord(c): str(unicodedata.decimal(c)) for c in set(text) if c.isdecimal() and not c.isascii()}
    return text.translate(odd) if odd else text


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits), 1))
    return total % 10 == 0


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def normal(kind: str, mention: str, gender: str = "") -> str | None:
    """An entity's value, the same for all its mentions; None: not an entity after all."""
    mention = ascii_digits(mention)
    if kind == "email":
        return mention.lower()
    if kind == "name":
        return f"{gender}:{' '.join(mention.casefold().split())}"
    value = re.sub(r"[^0-9A-Za-z+]" if kind != "ip" else r"[^0-9.]", "", mention)
    if kind == "card" and not (luhn(value) and len(set(value)) > 1):
        return None
    if kind == "iban" and mod97(value) != 1:
        return None
    return value


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """Entities as (start, end, kind, value), without overlaps."""
    text = ascii_digits(text)
    found = []
    for rank, kind in enumerate(PATTERNS):
        if kind == "email" and "@" not in text:
            continue
        for m in PATTERNS[kind].finditer(text):
            part = "v" if kind == "name" else 0
            if (value := normal(kind, m.group(part), "f" if kind == "name" and m.group("f") else "m")) is not None:
                found.append((m.start(part), -m.end(part), rank, kind, value))
    out, end = [], 0
    for start, stop, _, kind, value in sorted(found):
        if start >= end:
            out.append((start, -stop, kind, value))
            end = -stop
    return out


class Draw:
    """Numbers below a bound from one HMAC stream."""

    def __init__(self, key: bytes, label: str):
        self.key, self.label, self.n = key, label, 0

    def __call__(self, below: int) -> int:
        self.n += 1
        return int.from_bytes(hmac.new(self.key, f"{self.label}|{self.n}".encode(), hashlib.sha256).digest()[:8], "big") % below


def drawn(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The surrogate's value for an entity's value."""
    d = Draw(key, f"{kind}|{value}|{attempt}")
    digit = lambda c: str(d(10)) if c.isdigit() else c
    if kind == "email":
        local, _, domain = value.partition("@")
        shape = "".join(str(d(10)) if c.isdigit() else chr(97 + d(26)) if c.isalpha() else c for c in local)
        shape += "".join(chr(97 + d(26)) for _ in range(attempt))
        part = Draw(key, f"domain|{domain}")
        return f"{shape}@{''.join(chr(97 + part(26)) for _ in range(8))}.example.{('com', 'net', 'org')[part(3)]}"
    more = [str(d(10)) for _ in range(attempt - 7)]  # nearly all of this shape is in use
    if kind == "ip" and more:
        return f"{1 + d(223)}.{d(256)}.{d(256)}.{1 + d(254)}"
    if kind == "ip":
        return f"{(11, 23, 45, 62, 78, 91, 104, 133, 151, 176, 188, 201)[d(12)]}.{d(256)}.{d(256)}.{1 + d(254)}"
    if kind == "card":
        body = value[0] + "".join([*(str(d(10)) for _ in value[1:-1]), *more])
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))
    if kind == "ssn":
        return f"{900 + d(100)}{1 + d(99):02d}{1 + d(9999):04d}{''.join(more)}"  # numbers that are never given out
    if kind == "iban":
        body = "".join(str(d(10)) if c.isdigit() else chr(65 + d(26)) for c in value[4:]) + "".join(more)
        return f"{value[:2]}{98 - mod97(value[:2] + '00' + body):02d}{body}"
    if kind == "name":
        gender, _, name = value.partition(":")
        script = "cyrillic" if re.search("[а-я]", name) else "latin"
        family = "".join(FAMILY[script][d(16)] for _ in range(3 + attempt)).capitalize()
        return f"{gender}:{family if ' ' not in name else GIVEN[script, gender][d(len(GIVEN[script, gender]))] + ' ' + family}"
    lead = 2 if value.startswith("+") else 1  # a phone number keeps the start of its country code
    return value[:lead] + "".join([*map(digit, value[lead:]), *more])


def written(kind: str, mention: str, surrogate: str) -> str:
    """A surrogate's value in the writing of a mention; the first digit tells the digits' script."""
    zero = next((ord(c) - unicodedata.decimal(c) for c in mention if c.isdecimal()), ord("0"))
    if zero != ord("0"):
        plain = written(kind, ascii_digits(mention), surrogate)
        return plain.translate({ord("0") + i: zero + i for i in range(10)})
    if kind == "name":
        plain = surrogate.partition(":")[2]
        return plain.upper() if mention.isupper() else plain
    if kind == "ip":
        return surrogate
    if kind == "email":
        return surrogate.upper() if mention.isupper() else surrogate
    letters = iter(surrogate)
    return "".join([*(next(letters, "") if c.isalnum() or c == "+" else c for c in mention), *letters])


def surrogates(entities: DataFrame, key: bytes, rounds: int = 100) -> DataFrame:
    """kind, value -> surrogate for distinct entities, no two alike and none an entity itself."""

    def draw(attempt: int):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = [drawn(key, k, v, attempt) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.string())], names=["kind", "value", "surrogate"])

        return run

    schema = "kind string, value string, surrogate string"
    pending, done = entities, None
    real = entities.select("kind", F.col("value").alias("surrogate"))
    for attempt in range(rounds):
        made = materialise(pending.select("kind", "value").mapInArrow(draw(attempt), schema), "surrogates")
        free = made.join(real, ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        first = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("value"))
        won = materialise(free.withColumn("k", first).filter("k = 1").select("kind", "value", "surrogate"), "surrogates")
        done = won if done is None else done.unionByName(won)
        pending = materialise(made.join(won, ["kind", "value"], "left_anti").select("kind", "value"), "pending")
        if not pending.limit(1).count():
            return done
    raise RuntimeError(f"surrogates still collide after {rounds} rounds")


#: Beginnings of the forms of address.
TITLES = ("Mr", "Ms", "Miss", "Herr", "Frau", "Mme", "Mlle", "Madame", "Monsieur", "Señor", "Sr", "Госпо", "г-")


#: Digits of all scripts; Java 17 doesn't know the last two yet.
DIGIT = r"[\p{Nd}\x{11F50}-\x{11F59}\x{1E4F0}-\x{1E4F9}]"


def may_hold(text: str) -> Column:
    """False for texts that hold no entity: no digit, no at sign, no form of address.  Plain searches cost a fraction of the patterns."""
    found = F.col(text).contains("@") | F.col(text).rlike(DIGIT)
    for t in TITLES:
        found = found | F.col(text).contains(t)
    return F.coalesce(found, F.lit(False))


FOUND = "array<struct<start:int,end:int,kind:string,value:string>>"


def detected(docs: DataFrame, text: str = "text") -> DataFrame:
    """key (of doc_id and text), found: the rows that hold entities, equal rows once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [(k, detect(t)) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            rows = [{"key": k, "found": [dict(zip(("start", "end", "kind", "value"), x, strict=True)) for x in f]} for k, f in rows if f]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("key", pa.string()), ("found", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())])))]))

    some = docs.filter(may_hold(text)).select(row_key(text).alias("key"), text)
    return some.mapInArrow(run, f"key string, found {FOUND}").dropDuplicates(["key"])


def row_key(text: str):  # noqa: ANN201
    return F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col(text)), 256)


def replace(docs: DataFrame, *, key: bytes, text: str = "text") -> DataFrame:
    """doc_id, text with surrogates, spans (kind:start:end, comma-joined, of the original), and the number of entities of each kind."""
    found = materialise(detected(docs, text), "entities")
    each = found.select("key", F.explode("found").alias("x")).select("key", "x.*")
    chosen = small(materialise(surrogates(materialise(each.select("kind", "value").distinct(), "distinct"), key), "chosen"), 200_000)
    spans = each.join(chosen, ["kind", "value"]).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "surrogate"))).alias("spans"))
    spans = small(materialise(spans, "spans"), 50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for t, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if own:
                    pieces, at = [], 0
                    for s in own:
                        pieces += [t[at : s["start"]], written(s["kind"], t[s["start"] : s["end"]], s["surrogate"])]
                        at = s["end"]
                    t = "".join(pieces) + t[at:]
                out.append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), b.column(2)], names=["doc_id", "text", "spans"])

    kind = "array<struct<start:int,end:int,kind:string,surrogate:string>>"
    hint = may_hold(text)
    touched = docs.filter(hint).select("doc_id", F.col(text).alias("text"), row_key(text).alias("key")).join(spans, "key", "left").select("doc_id", "text", "spans")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    done = touched.mapInArrow(run, f"doc_id {id_type}, text string, spans {kind}")
    rest = docs.filter(~hint).select("doc_id", F.col(text).alias("text"), F.lit(None).cast(kind).alias("spans"))
    both = done.unionByName(rest).withColumn("spans", F.coalesce("spans", F.array().cast(kind)))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    joined = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return both.select("doc_id", "text", joined.alias("spans"), *[count(k) for k in KINDS])
