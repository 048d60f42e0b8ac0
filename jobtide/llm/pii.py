"""Personal data by weak supervision, with DataFrame functions only.

1. Base patterns and wider ones (spelled-out addresses, numbers without a plus sign,
   identity numbers, credentials) give candidate spans with the text around them.
   Offsets are running sums of the lengths of the pieces between matches, so no text is
   searched twice and the work is linear in the matches of a text.
2. Five labelers vote yes, no or abstain on each candidate: a strict reading of the
   pattern, a format test, a gazetteer (endings, calling codes, issuers, reserved
   addresses, placeholders), the words around it, and its edges.
3. Expectation-maximisation over the counts of vote patterns (a table bounded by the
   labelers, not by the data) estimates each labeler's reliability, and with it a
   probability for each pattern.
4. A logistic span classifier is fitted to those probabilities. Its inputs are the kind
   and the votes and, beyond them, the length, the share of digits and the characters
   before and after. It decides the wider candidates; base spans always stay.

Everything except the fit on the bounded table runs as one map over the texts, a
written table of candidates, and one small aggregation.

Defined results: null and empty texts have no spans; redaction leaves them as they are.
Of overlapping spans of one kind the base one stays, then the earlier, then the shorter.
Repeated rows each give a row; a null id is carried; extra columns are ignored, or
carried whatever their names. Very long texts are searched whole. An empty table gives no
rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import let, running, written

#: Kinds in the order in which spans are listed.
KINDS = ["email", "ip", "card", "phone", "secret", "ssn"]
BASE = KINDS[:4]

_LOCAL = r"[A-Za-z0-9._%+-]"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: (kind, is base, pattern, text that must occur). Possessive repeats keep long runs linear and off the
#: stack; none of them changes what matches. An address is tried at the start of a run of its
#: characters or where the last match ended, and a number of an IP address at the start of a run of digits, as any later
#: start in a run fails like the first.
PATTERNS = [
    ("email", True, rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", True, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]"),
    ("card", True, r"[0-9](?:[ -]?[0-9])++", "[0-9]"),
    ("phone", True, r"\+[0-9][ ().0-9-]+[0-9]", r"\+"),
    ("email", False, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?i:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]++(?: ?(?:(?i:\(dot\)|\[dot\]|\{dot\})|\.) ?[A-Za-z]{2,24}+)++", r"(?i)[(\[{]at[)\]}]"),
    ("phone", False, r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])", "[0-9]"),
    ("secret", False, r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[ ]?[=:][ ]?\"?[A-Za-z0-9/_+.-]{8,}+\"?)", "AKIA|[=:]"),
    ("ssn", False, r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]"),
]
#: What the gazetteer labeler knows: endings of addresses, calling codes, first digits of card issuers, addresses that
#: name no one, and values that stand for a credential. Our own choice of public lists.
ENDINGS = """com net org edu gov mil int io co dev app info biz name me tv eu at au be br ca ch cl cn cz de dk es fi fr gr
hu ie il in it jp kr mx nl no nz pl pt ro ru se sg sk tr tw ua uk us za""".split()
CALLING = """1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84
86 90 91 92 93 94 95 98 212 213 216 218 234 254 351 352 353 354 358 359 370 371 372 380 385 386 420 421 852 886 966 971 972""".split()
ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[4-8]|6011|64|65|62)"
RESERVED = r"^(?:0|127|22[4-9]|2[3-5][0-9])\."
PLACEHOLDERS = "(?i)example|changeme|your[_-]|xxxx|placeholder|redacted"
CUES = ["mail", "email", "contact", "write", "call", "phone", "tel", "fax", "mobile", "card", "visa", "iban", "server", "host", "ip", "login", "password", "token", "key", "secret", "ssn"]
AGAINST = ["version", "release", "chapter", "section", "page", "isbn", "order", "invoice", "build", "part"]
LABELERS = 5
#: Characters around a candidate that the labelers see.
CONTEXT = 24
ROUNDS = 60
#: Inputs of the classifier beside kind and votes, and their numbers of classes.
SHAPES = {"size": 8, "digits": 4, "lead": 4, "trail": 4}


def _found(kind: str, base: bool, pattern: str, hint: str) -> Column:
    """Array of struct(kind, base, first, last, match, before, after) of one pattern in column ``body``."""
    matches = F.regexp_extract_all("body", F.lit(pattern), F.lit(0))

    def rows(zipped: Column) -> Column:
        lengths = F.transform(zipped, lambda x: (F.length(x["piece"]) + F.coalesce(F.length(x["hit"]), F.lit(0))).cast("long"))
        return F.zip_with(
            zipped, running(lengths, lambda a, b: a + b, 0),
            lambda x, end: F.struct(
                F.lit(kind).alias("kind"), F.lit(base).alias("base"),
                (end - F.length(x["hit"])).cast("int").alias("first"), end.cast("int").alias("last"), x["hit"].alias("match"),
                F.right(x["piece"], F.lit(CONTEXT)).alias("before"), F.left(F.coalesce(x["after"], F.lit("")), F.lit(CONTEXT)).alias("after"),
            ),
        )

    # there is a piece more than there are matches; its row has no match and is dropped
    zipped = let(F.split("body", pattern), lambda p: F.arrays_zip(p.alias("piece"), matches.alias("hit"), F.slice(p, 2, F.size(p)).alias("after")))
    return F.when(F.col("body").rlike(hint), F.filter(let(zipped, rows), lambda r: r["match"].isNotNull()))


def luhn(match: Column) -> Column:
    """Whether the digits of a string pass the Luhn test."""
    digits = F.reverse(F.regexp_replace(match, "[^0-9]", ""))
    values = F.transform(F.split(digits, ""), lambda d, i: F.try_to_number(d, F.lit("9")).cast("int") * (1 + i % 2))
    total = F.aggregate(values, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0)) - F.when(v > 9, 9).otherwise(0))
    return total % 10 == 0


def _valid(r: Column) -> Column:
    """The conditions of the base patterns; always true for the wider ones."""
    digits = F.length(F.regexp_replace(r["match"], "[^0-9]", ""))
    return (
        F.when(~r["base"] | (r["kind"] == "email"), True)
        .when(r["kind"] == "ip", r["match"].rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
        .when(r["kind"] == "phone", digits.between(8, 15))
        .when(~digits.between(16, 19), False)
        .otherwise(luhn(r["match"]))
    )


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(r: Column) -> Column:
    """The five labelers' votes on one candidate, as an array of -1, 0 and 1."""
    digits = F.length(F.regexp_replace(r["match"], "[^0-9]", ""))
    kind, match, before, after = r["kind"], r["match"], F.lower(r["before"]), F.lower(r["after"])
    value = F.regexp_replace(match, '^[^=:]*[=:] ?"?|"$', "")
    strict = (
        F.when(kind == "email", _vote(match.rlike(r"[A-Za-z0-9]@[A-Za-z0-9].*\.[A-Za-z]{2,24}$"), match.rlike(r"^[.%+-]|\.\.|\.-|-\.|[0-9]$")))
        .when(kind == "ip", _vote(match.rlike(r"^[1-9][0-9]*(\.(0|[1-9][0-9]*)){3}$"), match.rlike(r"(^|\.)0[0-9]")))
        .when(kind == "card", _vote(match.rlike(r"^([0-9]+|([0-9]{4}[ -]){3}[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$"), match.rlike("(^|[ -])[0-9][ -]")))
        .when(kind == "phone", _vote(match.rlike(r"^(\+[1-9][0-9]{0,2}[ .-]?)?(\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])?[0-9]{2,4}([ .-]?[0-9]{2,4})+$"), match.rlike(r"\.\.|--|[(][^()]*$|^[^(]*[)]")))
        .when(kind == "secret", _vote(match.startswith("AKIA") | (value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.length(value) >= 12)), value.rlike("^[A-Za-z]+$")))
        .otherwise(_vote(match.rlike("^[0-8][0-9]{2}-[0-9]{2}-[0-9]{4}$"), match.startswith("9")))
    )
    form = (
        F.when(kind == "card", _vote(digits == 16, digits > 16)).when(kind == "ip", _vote(~match.rlike(r"^0|\.0[0-9]"), match.rlike(r"^0")))
        .when(kind == "phone", _vote(digits.between(10, 15), digits < 9))
        .when(kind == "ssn", _vote(~match.rlike("^(000|666|9)|-00-|-0000$"), match.rlike("^(000|666|9)|-00-|-0000$")))
        .when(kind == "secret", _vote(match.startswith("AKIA") | digits.between(2, 120), digits == 0)).otherwise(_vote(F.length(match).between(6, 254), F.length(match) > 254))
    )
    known = (
        F.when(kind == "email", _vote(F.lower(match).rlike(f"(?:{'|'.join(ENDINGS)})$"), match.rlike("[0-9]$")))
        .when(kind == "phone", _vote(match.rlike(rf"^\+(?:{'|'.join(CALLING)})[ (.-]"), match.startswith("+0")))
        .when(kind == "secret", _vote(match.rlike("^(?i:AKIA|password|passwd|pwd|secret|token|api|access)") & ~match.rlike(PLACEHOLDERS), match.rlike(PLACEHOLDERS)))
        .when(kind == "ip", _vote(F.lit(False), match.rlike(RESERVED)))
        .when(kind == "card", _vote(match.rlike(ISSUERS), ~match.rlike(ISSUERS))).otherwise(F.lit(0))
    )
    cues, against = rf"\b(?:{'|'.join(CUES)})\b", rf"\b(?:{'|'.join(AGAINST)})\b"
    context = _vote(before.rlike(cues) | after.rlike(cues), before.rlike(against) | after.rlike(r"^ ?(?:%|km|kg|eur|usd)\b"))
    edges = _vote(before.rlike(r"(?:^|[\s(\"':,;])$") & after.rlike(r"^(?:$|[\s)\"':,;.!?])"), before.rlike(r"[\w/.#-]$") | after.rlike(r"^[\w/#-]"))
    return F.array(strict, form, known, context, edges)


def _edge_class(c: Column) -> Column:
    """0: no character, 1: white space, 2: letter or digit, 3: any other."""
    return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"[\p{L}\p{Nd}]"), 2).otherwise(3)


def shapes(r: Column) -> list[Column]:
    """The classifier's inputs beside kind and votes (see ``SHAPES``)."""
    length = F.length(r["match"])
    share = F.length(F.regexp_replace(r["match"], "[^0-9]", "")) / length
    return [
        F.least(F.floor(F.log2(length)), F.lit(7)).cast("int").alias("size"),
        F.least(F.floor(share * 4), F.lit(3)).cast("int").alias("digits"),
        _edge_class(F.right(r["before"], F.lit(1))).alias("lead"),
        _edge_class(F.left(r["after"], F.lit(1))).alias("trail"),
    ]


def candidates(docs: DataFrame) -> DataFrame:
    """docs(id, body, ...) -> the same without body, with ``spans``: the valid candidates and their votes."""
    names = []
    for i, p in enumerate(PATTERNS):
        names.append(f"_k{i}")
        docs = docs.withColumn(names[-1], _found(*p))
    none = F.array().cast("array<struct<kind:string,base:boolean,first:int,last:int,match:string,before:string,after:string>>")
    docs = docs.withColumn("_all", F.concat(*[F.coalesce(n, none) for n in names])).drop(*names)
    voted = F.transform(
        F.filter("_all", _valid),
        lambda r: F.struct(
            r["kind"].alias("kind"), r["base"].alias("base"), r["first"].alias("first"), r["last"].alias("last"), votes(r).alias("votes"), *shapes(r),
        ),
    )
    return docs.withColumn("spans", voted).drop("_all")


def reliabilities(counts: list[tuple]) -> tuple[dict, dict, list[float]]:
    """EM over (kind, votes, shapes, n): each labeler's (yes given true, yes given false), the priors by kind, and P(true) per row."""
    kinds = sorted({c[0] for c in counts})
    prior = {k: 0.7 for k in kinds}
    rate = {j: (0.8, 0.3) for j in range(LABELERS)}
    truth = [0.5] * len(counts)
    for _ in range(ROUNDS):
        for i, (kind, vote, _shapes, _n) in enumerate(counts):
            yes, no = math.log(prior[kind]), math.log(1 - prior[kind])
            for j, v in enumerate(vote):
                if v:
                    a, b = rate[j]
                    yes += math.log(a if v > 0 else 1 - a)
                    no += math.log(b if v > 0 else 1 - b)
            truth[i] = 1 / (1 + math.exp(min(50, max(-50, no - yes))))
        for k in kinds:
            own = [(t, c[3]) for t, c in zip(truth, counts, strict=True) if c[0] == k]
            prior[k] = min(0.98, max(0.02, (sum(t * n for t, n in own) + 1) / (sum(n for _, n in own) + 2)))
        for j in range(LABELERS):
            # a weak belief that labelers are better than chance keeps the two classes from trading names
            hit = [8.0, 2.0, 3.0, 7.0]
            for t, (_k, vote, _s, n) in zip(truth, counts, strict=True):
                if vote[j]:
                    hit[0 if vote[j] > 0 else 1] += t * n
                    hit[2 if vote[j] > 0 else 3] += (1 - t) * n
            rate[j] = tuple(min(0.99, max(0.01, x)) for x in (hit[0] / (hit[0] + hit[1]), hit[2] / (hit[2] + hit[3])))
    return rate, prior, truth


def span_classifier(counts: list[tuple], truth: list[float], steps: int = 400, rate: float = 1.0) -> dict:
    """Weighted logistic fit on the bounded table: a weight by kind, by labeler and by class of each shape, with a small penalty."""
    names = [("kind", k) for k in KINDS] + [("vote", j) for j in range(LABELERS)] + [(name, c) for name, most in SHAPES.items() for c in range(most)]
    at = {name: i for i, name in enumerate(names)}
    inputs, weigh = np.zeros((len(counts), len(names))), np.zeros(len(counts))
    for i, (kind, vote, shape, n) in enumerate(counts):
        inputs[i, at["kind", kind]] = 1
        for j, v in enumerate(vote):
            inputs[i, at["vote", j]] = v
        for pair in zip(SHAPES, shape, strict=True):
            inputs[i, at[pair]] = 1
        weigh[i] = n
    weight = np.array([0.5 if group == "vote" else 0.0 for group, _ in names])
    for _ in range(steps if len(counts) else 0):
        p = 1 / (1 + np.exp(-np.clip(inputs @ weight, -50, 50)))
        weight -= rate * (inputs.T @ ((p - np.array(truth)) * weigh / weigh.sum()) + 1e-4 * weight)
    return dict(zip(names, weight.tolist(), strict=True))


def _score(r: Column, weight: dict) -> Column:
    total = sum((r["votes"][j] * F.lit(weight["vote", j]) for j in range(LABELERS)), F.lit(0.0))
    for name in ("kind", *SHAPES):
        of = F.lit(0.0)
        for (group, value), w in weight.items():
            if group == name:
                of = F.when(r[name] == value, F.lit(w)).otherwise(of)
        total = total + of
    return total


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


#: Ends of a span as one long: its kind's rank, then the place.
_KIND = 1 << 40


def _apart(ordered: Column) -> Column:
    """The spans without added ones that overlap an earlier span or a base span of their kind; ``ordered`` by rank, first, added."""
    key = lambda r, end: r["rank"] * _KIND + r[end]
    furthest = lambda s: running(F.transform(s, lambda r: key(r, "last")), F.greatest, 0)
    next_base = lambda s: F.reverse(running(F.reverse(F.transform(s, lambda r: F.when(r["added"], F.lit(1 << 62)).otherwise(key(r, "first")))), F.least, 1 << 62))
    keep = lambda s, far, near: F.filter(
        s, lambda r, i: ~r["added"] | ((F.coalesce(F.get(far, i - 1), F.lit(0)) <= key(r, "first")) & (F.get(near, i) >= key(r, "last")))
    )
    return let(ordered, lambda s: let(furthest(s), lambda far: let(next_base(s), lambda near: keep(s, far, near))))


def _spans(docs: DataFrame, text_col: str, carried: list[str]) -> DataFrame:
    """(row, spans): the carried columns as a struct of c0, c1, ... and an array of (kind, base, first, last), by kind, then start."""
    row = F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(carried)]).alias("row")
    found = candidates(docs.select(row, F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("body")))
    found = written(found.select("row", "spans"), "candidates")
    patterns = found.where(F.size("spans") > 0).select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", *[f"s.{n}" for n in SHAPES]).count()
    # bounded by the kinds, the votes (3 to the power of LABELERS) and the classes of the shapes
    counts = [(r["kind"], tuple(r["votes"]), tuple(r[n] for n in SHAPES), r["count"]) for r in patterns.orderBy("kind", "votes", *SHAPES).collect()]
    _, _, truth = reliabilities(counts)
    weight = span_classifier(counts, truth)
    kept = F.filter("spans", lambda r: r["base"] | (_score(r, weight) >= 0))
    ordered = F.array_sort(
        F.transform(
            kept,
            lambda r: F.struct(_rank(r["kind"]).alias("rank"), r["first"].alias("first"), (~r["base"]).alias("added"), r["last"].alias("last"), r["kind"].alias("kind")),
        )
    )
    spans = F.transform(_apart(ordered), lambda r: F.struct(r["kind"].alias("kind"), (~r["added"]).alias("base"), r["first"].alias("first"), r["last"].alias("last")))
    return found.select("row", F.when(F.size("spans") > 0, spans).otherwise(F.array().cast("array<struct<kind:string,base:boolean,first:int,last:int>>")).alias("spans"))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): an array of (kind, base, first, last) for each row, ordered by kind, then start."""
    return _spans(docs, text_col, [id_col]).select(F.col("row.c0").alias(id_col), "spans")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda r: F.concat_ws(":", r["kind"], r["first"].cast("string"), r["last"].cast("string"))), ",")


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns."""
    base = F.filter("spans", lambda r: r["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda r: r["base"] & (r["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return found.select(id_col, *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


#: Spans that are replaced in one piece of a text; a position in a string is found by walking to it, so pieces keep long texts linear.
PIECE = 128


def _replaced(text: Column, spans: Column) -> Column:
    """The text with each span (in text order) replaced by its kind; what overlaps an earlier span is covered by it."""
    tag = lambda k: F.concat(F.lit("["), F.upper(k["kind"]), F.lit("]"))
    part = lambda whole, at, end: F.substr(whole, (at + 1).cast("int"), (end - at).cast("int"))

    def joined(kept: Column, end: Column) -> Column:  # kept: (at, first, kind), at: where the text goes on before it
        def piece(i: Column) -> Column:
            at = kept[i * PIECE]["at"]
            stop = F.coalesce(F.get(kept, (i + 1) * PIECE)["at"], end)
            own = F.slice(kept, i * PIECE + 1, PIECE)
            return let(part(text, at, stop), lambda t: F.array_join(F.transform(own, lambda k: F.concat(part(t, k["at"] - at, k["first"] - at), tag(k))), ""))

        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(kept) - 1) / PIECE).cast("int")), piece)
        return F.concat(F.array_join(pieces, ""), F.substr(text, (end + 1).cast("int")))

    def told(s: Column, ends: Column) -> Column:
        open_at = F.transform(s, lambda r, i: F.struct(F.coalesce(F.get(ends, i - 1), F.lit(0)).alias("at"), r["first"].alias("first"), r["kind"].alias("kind")))
        return let(F.filter(open_at, lambda k: k["first"] >= k["at"]), lambda kept: joined(kept, F.element_at(ends, -1)))

    return let(spans, lambda s: let(running(F.transform(s, lambda r: r["last"].cast("long")), F.greatest, 0), lambda ends: told(s, ends)))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every span found replaced by its kind in square brackets; ``n_chars``, where there, follows."""
    names = docs.columns
    found = _spans(docs, text_col, names)
    text = F.col(f"row.c{names.index(text_col)}")
    ordered = F.array_sort(F.transform("spans", lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last"), r["kind"].alias("kind"))))
    some = text.isNotNull() & (F.size("spans") > 0)
    out = found.select("row", some.alias("some"), F.when(some, _replaced(text, ordered)).otherwise(text).alias("clean"))
    new = {text_col: F.col("clean")}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("some"), F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(f"row.c{names.index('n_chars')}"))
    return out.select(*[new.get(c, F.col(f"row.c{i}")).alias(c) for i, c in enumerate(names)])


def op9_weak_supervision_pii(spark, sf_dir: str) -> DataFrame:
    """The contract's counts and spans of every whole document."""
    return summary(find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet")))
