"""Scalar functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of weakness by a sink's category.
WEAKNESS_KINDS = {
    "command": "CommandInjectionCandidate",
    "file": "PathTraversalOrFileAccessCandidate",
    "sql": "SqlInjectionCandidate",
    "network": "SsrfCandidate",
    "redirect": "OpenRedirectCandidate",
    "deserialization": "UnsafeDeserializationCandidate",
    "reflection": "UnsafeReflectionCandidate",
    "rpc": "RpcDispatchReachabilityCandidate",
}
OTHER_WEAKNESS = "DangerousDataFlowCandidate"
#: Weakness numbers by kind.
WEAKNESS_NUMBERS = {
    "CommandInjectionCandidate": "CWE-78",
    "PathTraversalOrFileAccessCandidate": "CWE-22",
    "SqlInjectionCandidate": "CWE-89",
    "SsrfCandidate": "CWE-918",
    "OpenRedirectCandidate": "CWE-601",
    "UnsafeDeserializationCandidate": "CWE-502",
    "UnsafeReflectionCandidate": "CWE-470",
}
#: Evidence kinds by score.
EVIDENCE_SCORES = {
    3: ("SourceRoslynDirect", "AssemblyIlDirect", "AssemblyIlGeneratedState", "AssemblyIlDelegateTarget", "SourceRoslynDelegateTarget"),
    2: ("SourceRoslynSummary", "AssemblyIlSummary", "AssemblyReflection", "ExternalSummary", "FrameworkModel"),
    1: ("SourceRoslynVirtualCandidate", "AssemblyIlVirtualCandidate", "ReflectionHeuristic", "LanguageFrontend"),
}
#: HTTP methods by attribute and by mapping call.
ATTRIBUTE_VERBS = {
    "httpget": "GET",
    "httppost": "POST",
    "httpput": "PUT",
    "httpdelete": "DELETE",
    "httppatch": "PATCH",
    "httphead": "HEAD",
    "httpoptions": "OPTIONS",
}
MAPPING_VERBS = {
    "MapGet": "GET",
    "MapPost": "POST",
    "MapPut": "PUT",
    "MapDelete": "DELETE",
    "MapPatch": "PATCH",
    "MapMethods": "ANY",
}
#: Protocol versions by a token in any case, the first that fits (F8).
PROTOCOL_VERSIONS = (
    ("SSL 3.0", ("Ssl3", "SSLv3")),
    ("TLS 1.1", ("Tls11", "TLSv1_1", "TLS1_1")),
    ("TLS 1.2", ("Tls12", "TLSv1_2", "TLS1_2")),
    ("TLS 1.3", ("Tls13", "TLSv1_3", "TLS1_3")),
)


def case(value: Column, table: dict[str, str], other: str | None = None) -> Column:
    """A value's entry in a small table."""
    out = F.lit(other).cast("string")
    for key, text in table.items():
        out = F.when(value == key, F.lit(text)).otherwise(out)
    return out


def has(text: Column, part: str) -> Column:
    """Whether ``part`` occurs in any case."""
    return F.contains(F.lower(text), F.lit(part.lower()))


def normal_symbol(symbol: Column) -> Column:
    """F1."""
    return F.replace(F.replace(symbol, F.lit("global::"), F.lit("")), F.lit("Global."), F.lit(""))


def trimmed_code(code: Column, most: int = 240) -> Column:
    """one line, at most ``most`` characters and an ellipsis."""
    line = F.trim(F.translate(code, "\r\n", "  "))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


def redacted(value: Column) -> Column:
    """F4."""
    return F.when(F.length(value) <= 8, F.lit("***")).otherwise(F.concat(F.left(value, F.lit(4)), F.lit("***"), F.right(value, F.lit(4))))


def fingerprint(value: Column) -> Column:
    """F5."""
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def identifier_parts(identifier: Column) -> Column:
    """the lower-cased parts of an identifier in mixed case."""
    parts = F.regexp_extract_all(identifier, F.lit(r"([A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+)"), F.lit(1))
    return F.transform(parts, F.lower)


def is_iv_name(identifier: Column) -> Column:
    """F7."""
    return F.arrays_overlap(identifier_parts(identifier), F.array(F.lit("iv"), F.lit("nonce")))


def is_secret_name(identifier: Column) -> Column:
    """F7."""
    parts = F.arrays_overlap(identifier_parts(identifier), F.array(*map(F.lit, ("key", "secret", "token", "password"))))
    return parts | has(identifier, "privatekey") | has(identifier, "clientsecret") | has(identifier, "jwtsecret")


def protocol_version(text: Column) -> Column:
    """F8."""
    out = F.lit(None).cast("string")
    for version, tokens in reversed(PROTOCOL_VERSIONS):
        fits = F.lit(False)
        for token in tokens:
            fits = fits | has(text, token)
        out = F.when(fits, F.lit(version)).otherwise(out)
    return out


def weakness_kind(category: Column) -> Column:
    """F9."""
    return case(category, WEAKNESS_KINDS, OTHER_WEAKNESS)


def weakness_number(kind: Column) -> Column:
    """F9."""
    return case(kind, WEAKNESS_NUMBERS)


def finding_number(rule: Column) -> Column:
    """hard-coded material, certificate checks turned off, and other cryptographic findings."""
    return F.when(has(rule, "HARDCODED"), "CWE-321").when(has(rule, "CERT"), "CWE-295").otherwise("CWE-327")


def evidence_score(kind: Column) -> Column:
    """F11."""
    out = F.lit(0)
    for score, kinds in EVIDENCE_SCORES.items():
        out = F.when(kind.isin(*kinds), F.lit(score)).otherwise(out)
    return out


def attribute_verb(name: Column) -> Column:
    """F12."""
    return case(F.lower(F.regexp_replace(name, "Attribute$", "")), ATTRIBUTE_VERBS)


def combined_route(first: Column, second: Column) -> Column:
    """F13."""
    blank = lambda x: F.coalesce(F.trim(x) == "", F.lit(True))
    joined = F.concat(F.rtrim(first, F.lit("/")), F.lit("/"), F.ltrim(second, F.lit("/")))
    return F.when(blank(first), second).when(blank(second), first).otherwise(joined)


def escaped(text: Column) -> Column:
    """Percent-escapes as RFC 3986 has them: letters, digits and ``-._~`` stay."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def package_url(name: Column, version: Column) -> Column:
    """F14."""
    return F.concat(F.lit("pkg:nuget/"), escaped(name), F.coalesce(F.concat(F.lit("@"), escaped(version)), F.lit("")))


def without_arity(name: Column) -> Column:
    """F15."""
    return F.regexp_replace(name, "`[0-9]+", "")


def relative_path(path: Column, base: Column) -> Column:
    """F16: below the base, the rest; elsewhere the path itself."""
    folder = F.concat(F.rtrim(base, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, folder), F.substring(path, F.length(folder) + 1, F.length(path))).otherwise(path)


def location(file: Column, line: Column, column: Column) -> Column:
    """null if the file is."""
    return F.concat(file, F.lit(":"), F.coalesce(line, F.lit(0)).cast("string"), F.lit(":"), F.coalesce(column, F.lit(0)).cast("string"))


def mermaid_label(text: Column) -> Column:
    """F18."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit("#quot;"))
    return F.translate(out, "\r\n", "  ")


def xml_text(text: Column) -> Column:
    """the five entities; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def last_segment(name: Column) -> Column:
    """F19."""
    return F.substring_index(name, ".", -1)


def name_space(name: Column) -> Column:
    """all but the last segment, or null."""
    return F.when(F.contains(name, F.lit(".")), F.regexp_replace(name, r"\.[^.]*$", ""))


def column_of(line: Column, part: Column) -> Column:
    """the 1-based column of ``part``, 1 if it's absent."""
    return F.greatest(F.lit(1), F.position(part, line))


def plural(count: Column, one: str) -> Column:
    """F22."""
    return F.concat(count.cast("string"), F.lit(f" {one}"), F.when(count == 1, "").otherwise("s"))


def weakness_digits(text: Column) -> Column:
    """the number in ``CWE-<n>``."""
    return F.regexp_extract(text, r"^CWE-(\d+)$", 1).try_cast("int")
