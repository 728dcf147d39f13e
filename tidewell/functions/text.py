"""Text functions as columns: trimming, folding, keys, hashes and safe cells.

All are built from Spark's own functions. Only ``nfc`` needs Python, as Spark has no
Unicode normal form; pass ``unicode=False`` where the input is known to be composed.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# White space as Unicode has it.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"

# Providers of personal mailboxes, whose domain names no company. A set in the order of the alphabet, which has no meaning.
PERSONAL_PROVIDERS = (
    "126.com", "163.com", "aol.com", "fastmail.com", "gmail.com", "gmx.com", "gmx.net", "googlemail.com",
    "hey.com", "hotmail.co.uk", "hotmail.com", "icloud.com", "live.com", "mac.com", "mail.com", "me.com",
    "msn.com", "outlook.com", "pm.me", "proton.me", "protonmail.com", "qq.com", "rediffmail.com",
    "rocketmail.com", "tutanota.com", "yahoo.co.in", "yahoo.co.uk", "yahoo.com", "yandex.com", "yandex.ru",
    "ymail.com", "zoho.com",
)

# What an unrendered template leaves in an address.
TEMPLATE_MARKERS = ("{{", "}}", "${", "%%", "[[", "]]")
MAX_EMAIL = 320

# Squashed header spellings of the built-in fields.
HEADER_ALIASES = {
    "email": "email", "emailaddress": "email", "workemail": "email",
    "fullname": "full_name", "name": "full_name",
    "company": "company.name", "companyname": "company.name", "account": "company.name",
    "companydomain": "company.domain", "domain": "company.domain", "website": "company.domain",
    "employees": "company.employees", "headcount": "company.employees", "companysize": "company.employees", "numberofemployees": "company.employees",
    "fundingstage": "company.funding_stage", "funding": "company.funding_stage", "stage": "company.funding_stage",
    "country": "company.region", "region": "company.region",
    "title": "title", "jobtitle": "title", "role": "title",
    "linkedinurl": "linkedin_url", "linkedin": "linkedin_url", "linkedinprofile": "linkedin_url",
    "segment": "segment", "segmentlabel": "segment",
    "triggersignalnote": "trigger_note", "triggernote": "trigger_note", "triggerevent": "trigger_note",
    "bestpathin": "warm_path", "bestpath": "warm_path", "pathin": "warm_path",
    "contactid": "contact_id", "apollocontactid": "contact_id", "personid": "contact_id",
}


def literal_map(table: Mapping[str, object]) -> Column:
    """A small constant map as a column."""
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def lookup(table: Mapping[str, object], key: Column) -> Column:
    """The constant table's value for ``key``, null where it has none."""
    if not table:
        return F.lit(None)
    return F.try_element_at(literal_map(table), key)


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def nfc(text: Column, unicode: bool = True) -> Column:
    return _nfc(text) if unicode else text


def trim(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def present(text: Column) -> Column:
    """Trimmed, empty as null."""
    return F.nullif(trim(text), F.lit(""))


def norm_text(text: Column, unicode: bool = True) -> Column:
    """How texts are compared: composed, trimmed, lower case."""
    return F.lower(trim(nfc(text, unicode)))


def norm_ordered(text: Column, unicode: bool = True) -> Column:
    """As ``norm_text``, and without spaces, hyphens and underscores."""
    return F.regexp_replace(norm_text(text, unicode), r"(?U)[\s_-]", "")


def squash_header(text: Column) -> Column:
    """Lower-case ASCII letters and digits of a header, nothing else."""
    return F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]", "")


def squash(header: str) -> str:
    """``squash_header`` for a header known while planning."""
    return "".join(c for c in header.translate({k: k + 32 for k in range(65, 91)}) if c.isascii() and (c.isdigit() or "a" <= c <= "z"))


def header_table(aliases: Mapping[str, str] | None = None) -> dict[str, str]:
    """Squashed header -> field: the built-in spellings under a rubric's own."""
    return HEADER_ALIASES | dict(aliases or {})


def resolve_header(header: str, table: Mapping[str, str]) -> str:
    """The field a header fills; empty if it squashes to nothing."""
    short = squash(header)
    return table.get(short, short)


def normalize_email(text: Column) -> Column:
    return F.lower(trim(text))


def normalize_name(text: Column, unicode: bool = True) -> Column:
    """Composed, lower case, runs of white space as one space."""
    return F.btrim(F.regexp_replace(F.lower(nfc(text, unicode)), r"(?U)\s+", " "))


def normalize_domain(text: Column) -> Column:
    """The host of a domain or URL: no scheme, path, user, port, last dot or ``www.``."""
    d = F.lower(trim(text))
    d = F.regexp_replace(d, r"(?s)^.*?://", "")
    d = F.regexp_replace(d, r"(?s)[/?#].*$", "")
    d = F.substring_index(d, "@", -1)
    d = F.regexp_replace(d, r"(?s):[^:]*$", "")
    return F.regexp_replace(F.regexp_replace(d, r"\.$", ""), r"^www\.", "")


def company_domain_of(email: Column) -> Column:
    """The company domain that a work email names, else null: none for personal providers and odd addresses."""
    at = F.length(email) - F.length(F.substring_index(email, "@", -1))
    domain = F.lower(trim(F.substring_index(email, "@", -1)))
    ok = (at > 1) & domain.contains(".") & ~domain.rlike(r"[ \t\r\n,;@]") & ~domain.isin(*PERSONAL_PROVIDERS)
    return F.when(ok, domain)


def email_fault(email: Column) -> Column:
    """Why a string cannot be one person's address, null if it can.

    The address grammar is dot-atoms (or a quoted local part) and a dotted domain; comments and address
    literals, which the full grammar allows, count as faults.
    """
    atom = r"[a-z0-9!#$%&'*+/=?^_`{|}~\u0080-￿-]+"
    bare = rf'(?i)^(?:{atom}(?:\.{atom})*|"(?:[^"\\\r\n]|\\.)*")@{atom}(?:\.{atom})*$'
    marks = F.lit(None).cast("string")
    for m in reversed(TEMPLATE_MARKERS):
        marks = F.when(F.contains(email, F.lit(m)), F.lit(f'an unfilled placeholder ({m}) stands in the email')).otherwise(marks)
    return (
        F.when(email.isNull() | (email == ""), F.lit("the email is blank"))
        .when(F.octet_length(email) > MAX_EMAIL, F.concat(F.lit(f"an email has {MAX_EMAIL} bytes at most, this one "), F.octet_length(email).cast("string")))
        .when(marks.isNotNull(), marks)
        .when(email.rlike(r"^[^,<>\"]*@[^,<>\"]*,"), F.lit("there are several addresses in the email"))
        .when(email.rlike(r"^\s|\s$|<[^<>]*@[^<>]*>$"), F.lit("something stands around the address"))
        .when(~email.rlike(bare), F.lit("the email has not the form of an address"))
        .when(~F.substring_index(email, "@", -1).contains("."), F.lit("the host of the email has no dot"))
    )


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once for a row, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def canonical_linkedin(text: Column, unicode: bool = True) -> Column:
    """``linkedin.com/in/<slug>`` or ``linkedin.com/pub/...`` of a profile URL, empty for anything else.

    A blank text is told first, and the parts of a URL are taken once each: rows without a URL cost nothing.
    """

    def taken(s: Column) -> Column:
        s = F.when(F.contains(s, F.lit("://")), s).otherwise(F.concat(F.lit("https://"), F.regexp_replace(s, "^//", "")))
        return _once(F.regexp_extract(s, r"(?s)^[a-z][a-z0-9+.-]*://(.*)$", 1), parted)

    def parted(rest: Column) -> Column:
        authority = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
        host = F.regexp_replace(F.substring_index(authority, "@", -1), r":\d*$", "")
        path = F.regexp_replace(F.regexp_replace(rest, r"(?s)^[^/?#]*", ""), r"(?s)[?#].*$", "")
        return F.struct(host.alias("host"), path.alias("path"))

    def plain_of(path: Column) -> Column:
        parts = F.filter(F.split(path, "/"), lambda p: p != "")
        return F.transform(parts, lambda p: F.lower(trim(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))))))

    def form(host: Column, path: Column, plain: Column, plain_ok: Column) -> Column:
        odd = F.exists(plain, lambda p: p.isNull() | p.isin("", ".", "..") | p.contains("/")) | path.rlike("%(?![0-9a-f]{2})")
        ours = (host == "linkedin.com") | host.endswith(".linkedin.com")
        head = F.try_element_at(plain_ok, F.lit(1))
        return (
            F.when(~ours | F.coalesce(odd, F.lit(True)) | (F.size(plain) < 2), F.lit(""))
            .when(head == "in", F.concat(F.lit("linkedin.com/in/"), F.try_element_at(plain_ok, F.lit(2))))
            .when(head == "pub", F.concat(F.lit("linkedin.com/"), F.array_join(F.slice(plain_ok, 1, 5), "/")))
        )

    s = F.lower(trim(text))
    url = _once(s, taken)
    if unicode:
        plain = plain_of(url["path"])
        made = form(url["host"], url["path"], plain, F.split(nfc(F.array_join(plain, "\x00")), "\x00"))
    else:
        made = _once(url, lambda u: _once(plain_of(u["path"]), lambda plain: form(u["host"], u["path"], plain, plain)))
    return F.when(s == "", F.lit("")).otherwise(F.coalesce(made, F.lit("")))


def normalize_person(text: Column, unicode: bool = True) -> Column:
    """A person reference as identities are keyed: email, profile URL, else an id as it stands."""
    s = trim(text)
    return F.when(s.contains("@"), normalize_email(s)).when(F.contains(F.lower(s), F.lit("linkedin.")), canonical_linkedin(s, unicode)).otherwise(s)


def row_hash(cols: Column, table: Mapping[str, str]) -> Column:
    """SHA-256 of a row's sorted header=value pairs and of the header table in use."""
    import hashlib

    fixed = hashlib.sha256("\x00".join(sorted(f"{k}={v}" for k, v in table.items())).encode()).digest()
    pairs = F.array_sort(F.transform(F.map_entries(cols), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")), F.lit("\x00"))))
    return F.sha2(F.concat(F.encode(F.array_join(pairs, ""), "UTF-8"), F.lit(bytearray(fixed))), 256)


def group_hash(row_hash: Column) -> Column:
    """An aggregate: one hash for the rows of a group, whatever their order; a single row's own, else that of their number and sums.

    The four 64-bit quarters of the rows' SHA-256 are summed, so that a group is combined part by part and holds four numbers.
    """
    quarter = lambda k: F.conv(F.substring(row_hash, 16 * k + 1, 16), 16, 10).cast("decimal(20,0)")
    sums = [F.sum(quarter(k)).cast("string") for k in range(4)]
    n = F.count(row_hash)
    return F.when(n == 1, F.min(row_hash)).otherwise(F.sha2(F.concat_ws("|", n.cast("string"), *sums), 256))


def key_of(rule: str, *parts: Column) -> Column:
    """``rule|n:part|...`` with each part's length in bytes, so two lists of parts never give one key."""
    out: list[Column] = [F.lit(rule)]
    for p in parts:
        p = F.coalesce(p, F.lit(""))
        out += [F.lit("|"), F.octet_length(p).cast("string"), F.lit(":"), p]
    return F.concat(*out)


def csv_safe(text: Column) -> Column:
    """A cell that no spreadsheet reads as a formula; signed numbers stay as they are."""
    head = F.ltrim(text)
    number = head.rlike(r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)$")
    return F.when(text.rlike(r"^[\t\r]") | (head.rlike(r"^[=+\-@]") & ~number), F.concat(F.lit("'"), text)).otherwise(text)


def printable(text: Column) -> Column:
    """Control characters as U+FFFD."""
    return F.regexp_replace(text, r"\p{Cntrl}", "�")


def format_number(value: Column) -> Column:
    """A double in its shortest plain form, without exponent or ``.0``."""
    plain = value.cast("string")
    wide = F.regexp_replace(F.regexp_replace(value.cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(plain.contains("E"), wide).otherwise(F.regexp_replace(plain, r"\.0$", ""))


def format_time(ts: Column) -> Column:
    """UTC with milliseconds, so that text order is time order; null as empty."""
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(""))


def split_name(full: Column) -> tuple[Column, Column]:
    """First name, and all other names."""
    parts = F.filter(F.split(full, r"(?U)\s+"), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")), F.array_join(F.slice(parts, 2, 1_000), " ")


def clip(text: str, most: int = 500) -> str:
    """At most ``most`` bytes, cut between characters."""
    return text.encode()[:most].decode(errors="ignore")


# How issuers say, in their public documentation, that their keys begin; what follows is letters, digits and joining signs.
KEY_PREFIXES = {
    "Amazon": ("AKIA", "ASIA"),
    "GitHub": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"),
    "GitLab": ("glpat-",),
    "Google": ("AIza", "ya29.", "GOCSPX-"),
    "HubSpot": ("pat-",),
    "OpenAI": ("sk-",),
    "Slack": ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "xapp-"),
    "Stripe": ("sk_live_", "sk_test_", "rk_live_", "whsec_"),
}
HIDDEN = "[hidden]"
#: HubSpot's prefix is a word too: its tokens go on with a region and a UUID.
_AFTER = {"pat-": r"[a-z]{2,}\d*-\p{XDigit}{8}(?:-\p{XDigit}{4}){3}-\p{XDigit}{12}"}


def _key_shapes() -> str:
    """One pattern for keys that tell themselves by their first letters, at the start of a word."""
    ways = ["\\Q" + p + "\\E" + _AFTER.get(p, r"[\w.\-]{4,}") for found in KEY_PREFIXES.values() for p in found]
    return r"(?<![\w-])(?:" + "|".join(ways) + ")"


def _armored() -> str:
    """A private key in text armor, from its first line through its last, or through the end of a text that was cut off."""
    kind, dashes = r"[^-\r\n]*PRIVATE KEY[^-\r\n]*", "-{5}"
    return f"(?s){dashes}BEGIN {kind}{dashes}.*?(?:{dashes}END {kind}{dashes}|\\z)"


def redact(text: Column, secrets: Iterable[str] = ()) -> Column:
    """For logs and stored reports: what opens a door is hidden, a person's address shortened, a home folder shown as ``~``.

    Hidden are the given ``secrets`` wherever they stand, whole private keys, what follows an authorization scheme (Bearer, Basic), signed
    web tokens (three base64url parts of which the first two are JSON objects) and keys of KEY_PREFIXES. Of an address the
    first character and the host are kept. Null stays null.
    """
    for s in sorted({s for s in secrets if s}, key=len, reverse=True):
        text = F.replace(text, F.lit(s), F.lit(HIDDEN))
    part = r"[\w-]+"
    token = rf"(?<![\w.-])eyJ{part}\.eyJ{part}\.{part}"
    for shape in (_armored(), r"(?i)(?<=\b(?:Bearer|Basic) {1,8})(?!\[)[^\s\"',;]+", token, _key_shapes()):
        text = F.regexp_replace(text, shape, HIDDEN)
    text = F.regexp_replace(text, r"(?U)([^\s@<>()\[\],;:\"'])[^\s@<>()\[\],;:\"']*+@((?:[\w-]+\.)+\w{2,})", "$1***@$2")
    return F.regexp_replace(text, r"/(?:home|Users)/[^/\s:]+", "~")
