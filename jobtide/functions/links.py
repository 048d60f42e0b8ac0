"""Link rules, as Column expressions over url strings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules as R
from .text import col, let, strings


def host_of(url: Column | str) -> Column:
    """Lower-cased host with its port."""
    return F.lower(F.regexp_extract(F.coalesce(col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def path_of(url: Column | str) -> Column:
    return F.regexp_extract(F.coalesce(col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query_of(url: Column | str) -> Column:
    return F.regexp_extract(F.coalesce(col(url), F.lit("")), r"^[^?#]*\?([^#]*)", 1)


def has_job_id(url: Column | str) -> Column:
    """The URL names one posting."""
    path = path_of(url)
    segment = F.lower(F.regexp_extract(path, R.JOB_PATH, 1))
    keys = F.transform(F.filter(F.split(query_of(url), "&"), lambda p: p.rlike("^[^=]+=.")), lambda p: F.lower(F.substring_index(p, "=", 1)))
    return path.rlike(R.UUID) | path.rlike(r"/\d{5,}") | ~segment.isin("", "search", "all", "list") | F.arrays_overlap(keys, strings(R.ID_PARAMS))


def looks_like_index(url: Column | str) -> Column:
    """A board or careers page rather than one posting."""
    path, host = path_of(url), host_of(url)
    on_board = reduce(lambda a, b: a | b, [host.endswith(h) | host.contains(f".{h}") for h in R.BOARD_HOSTS])
    few = F.size(F.filter(F.split(path, "/"), lambda s: s != "")) <= 1
    root = F.when(path == "", F.lit("/")).otherwise(path).rlike(R.INDEX_PATH)
    return (F.coalesce(col(url), F.lit("")) != "") & ~has_job_id(url) & (root | (on_board & few))


def is_known_blocked(url: Column | str) -> Column:
    """The host or a parent domain of two labels or more is listed."""

    def of(host: Column) -> Column:
        labels = F.split(host, r"\.")
        parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
        return F.arrays_overlap(parents, strings(R.BLOCKED_HOSTS))

    return let(F.substring_index(host_of(url), ":", 1), of)


def classify_link(url: Column | str, final_url: Column | str, status: Column | str) -> Column:
    """Verdict on a link that was already resolved."""
    status = col(status)
    return (
        F.when(F.coalesce(col(url), F.lit("")) == "", "dead")
        .when(status.isin(R.GONE), "dead").when(status.isin(R.BLOCKED), "blocked").when(status >= 400, "unreachable")
        .when(looks_like_index(final_url), "redirected_to_index").otherwise("ok")
    )


def link_note(url: Column | str, final_url: Column | str, status: Column | str) -> Column:
    """The remark that goes with the verdict."""
    verdict, http = classify_link(url, final_url, status), F.concat(F.lit("HTTP "), col(status).cast("string"))
    return (
        F.when(F.coalesce(col(url), F.lit("")) == "", F.lit(None))
        .when(verdict == "blocked", F.concat(http, F.lit(" - bot protection, verdict unknown"))).when(verdict.isin("dead", "unreachable"), http)
        .when((verdict == "redirected_to_index") & (col(final_url) != col(url)), "redirected to a board index")
        .when(verdict == "redirected_to_index", "URL carries no requisition id")
    )


def is_expiry_signal(verdict: Column | str) -> Column:
    return col(verdict).isin("dead", "redirected_to_index")


def host_key(url: Column | str) -> Column:
    """The last two labels of the host."""
    labels = F.split(F.substring_index(host_of(url), ":", 1), r"\.")
    return let(labels, lambda a: F.array_join(F.slice(a, F.greatest(F.size(a) - 1, F.lit(1)), 2), "."))


def neutralize_formula(text: Column | str) -> Column:
    """Text that a spreadsheet would run is quoted; null is empty."""
    text = F.coalesce(col(text), F.lit(""))
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def redact_secrets(text: Column | str, secrets: list[str]) -> Column:
    """Configured secrets of 12 characters or more, longest first."""
    out = col(text)
    for secret in sorted({s for s in secrets if len(s) >= 12}, key=lambda s: (-len(s), s)):
        out = F.replace(out, F.lit(secret), F.lit("[redacted]"))
    return out
