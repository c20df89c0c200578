"""Lines, context and literals of source texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.scalars import column_of, fingerprint, is_iv_name, is_secret_name, redacted

#: Quoted base64 or hex of 32 characters or more, or a PEM block; a quoted text of 8 or more.
QUOTED_SECRET = r'"((?:[A-Za-z0-9+/]{32,}={0,2}|[A-Fa-f0-9]{32,}|-----BEGIN [^-]+-----[\s\S]*?-----END [^-]+-----))"'
QUOTED_LITERAL = r'"([^"\r\n]{8,})"'
IDENTIFIER = r"\b([A-Za-z_][A-Za-z0-9_]*)\b"
ABSOLUTE_URL = r"""(?i)https?://[^\s"'<>]+"""
#: Words that are no identifiers.
KEYWORDS = ("private", "public", "protected", "internal", "static", "readonly", "const", "string", "byte", "var", "new", "return")
#: Lines of declarations by language, in which no symbol is looked for.
DECLARATIONS = {
    "csharp": r"(?i)^(?:public|private|protected|internal|static|sealed|virtual|override|async|partial|extern|friend|shared|overrides|overridable|notinheritable|mustoverride|withevents|dim|sub|function)\b.*\([^;=]*\)\s*(?:=>|\{|$)",
    "fsharp": r"(?i)^(?:let|member)\s+",
    "cpp": r"^[\w:<>*&\s]+\s+\w+\s*\([^;]*\)\s*(?:const\s*)?\{?$",
}
#: Declarations that set the context by language, (pattern, group) of namespace, class and method.
CPP_CONTEXT = r"(?:(\w+)::)?(\w+)\s*\([^;]*\)\s*(?:const\s*)?\{"
CONTEXT = {
    "fsharp": ((r"^(?:namespace|module)\s+([\w\.]+)", 1), (r"^type\s+(\w+)", 1), (r"^(?:let|member)\s+(?:rec\s+)?(?:\w+\.)?(\w+)", 1)),
    "r": (None, None, (r"^(\w+)\s*(?:<-|=)\s*function\s*\(", 1)),
    "cpp": (None, (CPP_CONTEXT, 1), (CPP_CONTEXT, 2)),
}
#: Part, rule, severity of misuse in a line.
MISUSES = (
    ("ServerCertificateCustomValidationCallback", "CRYPTO-TLS-CERT-VALIDATION-DISABLED", "High"),
    ("DangerousAcceptAnyServerCertificateValidator", "CRYPTO-TLS-CERT-VALIDATION-DISABLED", "High"),
    ("CipherMode.ECB", "CRYPTO-ECB-MODE", "High"),
    ("SecurityAlgorithms.None", "CRYPTO-JWT-NONE", "High"),
    ("SslProtocols.Ssl3", "CRYPTO-LEGACY-TLS", "High"),
    ("SslProtocols.Tls11", "CRYPTO-LEGACY-TLS", "Medium"),
    ("SSL_VERIFY_NONE", "CRYPTO-TLS-CERT-VALIDATION-DISABLED", "High"),
)
LEAST_ITERATIONS = 100_000


def lines(files: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A row per line: the columns kept, line (from 1) and code."""
    keep = keep or [c for c in files.columns if c != text]
    return files.select(*keep, F.posexplode(F.split(text, "\r?\n")).alias("_l", "code")).withColumn("line", F.col("_l") + 1).drop("_l")


def with_context(rows: DataFrame, file: str = "path", language: str = "language") -> DataFrame:
    """Namespace, class and method of the last declaration at or before each line of a file."""
    trimmed, columns = F.trim("code"), {}
    for i, name in enumerate(("namespace", "class", "method")):
        found = F.lit(None).cast("string")
        for key, patterns in CONTEXT.items():
            if patterns[i]:
                found = F.when(F.col(language) == key, F.regexp_extract(trimmed, *patterns[i])).otherwise(found)
        columns[name] = F.when(found != "", found)
    w = Window.partitionBy(file).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({k: F.last(v, ignorenulls=True).over(w) for k, v in columns.items()})


def urls(text: Column) -> Column:
    """The distinct absolute URLs of a text, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({ABSOLUTE_URL})"), F.lit(1)))


def identifiers(code: Column) -> Column:
    """A line's identifiers without keywords."""
    return F.filter(F.regexp_extract_all(code, F.lit(IDENTIFIER), F.lit(1)), lambda x: ~x.isin(*KEYWORDS))


def likely_declaration(code: Column, language: Column) -> Column:
    """P14."""
    trimmed, no_value = F.trim(code), ~F.contains(code, F.lit("="))
    return (
        F.when(language.isin("csharp", "vb", "text"), trimmed.rlike(DECLARATIONS["csharp"]))
        .when(language == "fsharp", trimmed.rlike(DECLARATIONS["fsharp"]) & no_value)
        .when(language == "cpp", trimmed.rlike(DECLARATIONS["cpp"]) & no_value).otherwise(F.lit(False))
    )


def symbol_candidates(rows: DataFrame) -> DataFrame:
    """Dotted or scoped names of each line that isn't a declaration, each once in any case."""
    names = F.regexp_extract_all("code", F.lit(r"([A-Za-z_][\w]*(?:(?:\.|::)[A-Za-z_][\w]*)*)"), F.lit(1))
    long = rows.filter(~likely_declaration(F.col("code"), F.col("language"))).select("*", F.posexplode(names).alias("pos", "symbol"))
    key = [c for c in rows.columns if c != "code"]
    best = long.withColumn("_v", F.lower("symbol")).groupBy(*key, "_v").agg(F.min_by(F.struct("symbol", "code"), "pos").alias("_b"))
    return best.select(*key, "_b.symbol", "_b.code")


def materials(rows: DataFrame) -> DataFrame:
    """Literals of secrets: material_type, identifier, column, redacted and fingerprint. The literal itself isn't kept.

    A line counts if it names something sensitive or holds a PEM block; an initial value takes any literal.
    """
    names = identifiers(F.col("code"))
    iv, secret = F.get(F.filter(names, is_iv_name), F.lit(0)), F.get(F.filter(names, is_secret_name), F.lit(0))
    kind = F.when(iv.isNotNull(), "iv-or-nonce").when(secret.isNotNull() | F.contains(F.col("code"), F.lit("-----BEGIN")), "key-or-secret")
    named = rows.withColumns({"material_type": kind, "identifier": F.coalesce(iv, secret)}).filter(F.col("material_type").isNotNull())
    pattern = F.when(F.col("material_type") == "iv-or-nonce", F.lit(QUOTED_LITERAL)).otherwise(F.lit(QUOTED_SECRET))
    long = named.withColumn("_v", F.explode(F.array_distinct(F.regexp_extract_all("code", pattern, F.lit(1)))))
    value = F.col("_v")
    return long.withColumns({
        "column": column_of(F.col("code"), F.concat(F.lit('"'), value)), "redacted": redacted(value), "fingerprint": fingerprint(value)}).drop("_v", "code")


def misuses(rows: DataFrame) -> DataFrame:
    """Findings of each line: rule, severity, column."""
    checks = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(r).alias("rule"), F.lit(s).alias("severity")) for p, r, s in MISUSES])
    hit = F.filter(checks, lambda c: F.contains(F.lower("code"), F.lower(c["part"])))
    out = rows.select("*", F.explode(hit).alias("_c")).select("*", "_c.rule", "_c.severity", column_of(F.lower("code"), F.lower("_c.part")).alias("column")).drop("_c")
    pbkdf2 = r"Rfc2898DeriveBytes\s*\([^\n;]*(\b\d{1,6}\b)"
    weak = F.regexp_extract("code", pbkdf2, 1).try_cast("int") < LEAST_ITERATIONS
    low = rows.filter(weak).select("*", F.lit("CRYPTO-LOW-PBKDF2-ITERATIONS").alias("rule"), F.lit("Medium").alias("severity"), column_of(F.col("code"), F.lit("Rfc2898DeriveBytes")).alias("column"))
    return out.unionByName(low)
