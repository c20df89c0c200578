"""Rule tables and their predicates.

Rules are data: (ord, target, kind, match, pattern, category). A row has one or more texts by kind; rows and rules meet
in an equi-join on the kind, with the broadcast rules (a few hundred rows), and the match is checked on what meets.
Patterns in regular expressions are case-sensitive, the other matches aren't.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULE_SCHEMA = "ord int, target string, kind string, match string, pattern string, category string, pack string"
#: The default sources: kind, pattern, match, category.
SOURCES = (
    ("Parameter", "Main", "Exact", "cli"),
    ("Parameter", "request", "Exact", "message"),
    ("Parameter", "command", "Exact", "message"),
    ("Parameter", "query", "Exact", "message"),
    ("Parameter", "model", "Exact", "http"),
    ("Parameter", "input", "Exact", "input"),
    ("Attribute", "HttpGet", "Prefix", "http"),
    ("Attribute", "HttpPost", "Prefix", "http"),
    ("Attribute", "HttpPut", "Prefix", "http"),
    ("Attribute", "HttpDelete", "Prefix", "http"),
    ("Attribute", "HttpPatch", "Prefix", "http"),
    ("Attribute", "Route", "Prefix", "http"),
    ("Attribute", "FunctionName", "Contains", "serverless"),
    ("Attribute", "HttpTrigger", "Contains", "serverless"),
    ("Type", "Microsoft.AspNetCore.Http.HttpRequest", "Contains", "http"),
    ("Type", "Microsoft.AspNetCore.Http.HttpContext", "Contains", "http"),
    ("Type", "Microsoft.AspNetCore.Http.IFormFile", "Contains", "http"),
    ("Method", "System.Console.ReadLine", "Contains", "cli"),
    ("Symbol", ".Request.Query", "Contains", "http"),
    ("Symbol", ".Request.Form", "Contains", "http"),
    ("Symbol", ".Request.Body", "Contains", "http"),
    ("Symbol", ".Request.Headers", "Contains", "http"),
    ("Symbol", ".Request.Cookies", "Contains", "http"),
    ("Code", "Request[", "Contains", "http"),
    ("Code", "Request.QueryString", "Contains", "http"),
    ("Code", ".Text", "Contains", "webforms"),
    ("Code", ".SelectedItem.Value", "Contains", "webforms"),
    ("Type", "Grpc.Core.ServerCallContext", "Contains", "rpc"),
)
#: The default sinks.
SINKS = (
    ("Method", "System.Diagnostics.Process.Start", "Contains", "command"),
    ("Type", "System.Diagnostics.ProcessStartInfo", "Contains", "command"),
    ("Method", "System.IO.File.", "Contains", "file"),
    ("Method", "System.IO.Directory.", "Contains", "file"),
    ("Method", "System.IO.FileStream", "Contains", "file"),
    ("Method", "System.IO.Path.Combine", "Contains", "file"),
    ("Name", "SaveAs", "Exact", "file"),
    ("Name", "CopyTo", "Exact", "file"),
    ("Code", "SaveAs(", "Contains", "file"),
    ("Code", "CopyTo(", "Contains", "file"),
    ("Code", "Server.MapPath", "Contains", "file"),
    ("Method", "System.Net.Http.HttpClient.", "Contains", "network"),
    ("Method", "Response.Redirect", "Contains", "redirect"),
    ("Name", "Redirect", "Exact", "redirect"),
    ("Method", "GetGrain", "Contains", "rpc"),
    ("Name", "GetGrain", "Exact", "rpc"),
    ("Method", "System.Data.SqlClient.SqlCommand", "Contains", "sql"),
    ("Method", "Microsoft.Data.SqlClient.SqlCommand", "Contains", "sql"),
    ("Method", "MySqlCommand", "Contains", "sql"),
    ("Method", "SqliteCommand", "Contains", "sql"),
    ("Name", "ExecuteNonQuery", "Exact", "sql"),
    ("Name", "ExecuteReader", "Exact", "sql"),
    ("Method", "ExecuteSqlRaw", "Contains", "sql"),
    ("Method", "FromSqlRaw", "Contains", "sql"),
    ("Method", "System.Reflection.Assembly.Load", "Contains", "reflection"),
    ("Method", "System.Type.GetType", "Contains", "reflection"),
    ("Method", "BinaryFormatter.Deserialize", "Contains", "deserialization"),
    ("Name", "Deserialize", "Exact", "deserialization"),
)
#: The default passthroughs and sanitizers.
PASSTHROUGHS = (
    ("Method", "System.String.Concat", "Contains", "string"),
    ("Method", "System.String.Format", "Contains", "string"),
    ("Method", "ToString", "Contains", "string"),
    ("Method", "Trim", "Contains", "string"),
    ("Method", "Replace", "Contains", "string"),
)
SANITIZERS = (
    ("Method", "System.Text.Encodings.Web.HtmlEncoder.Encode", "Contains", "html-encoding"),
    ("Method", "System.Net.WebUtility.HtmlEncode", "Contains", "html-encoding"),
    ("Method", "System.Uri.EscapeDataString", "Contains", "url-encoding"),
    ("Method", "System.Text.RegularExpressions.Regex.IsMatch", "Contains", "validation"),
    ("Name", "IsMatch", "Exact", "validation"),
    ("Name", "TryParse", "Exact", "validation"),
)
#: Packs that can be added: target, kind, pattern, match, category (P10).
PACKS = {
    "aspnet": (
        ("Source", "Type", "Microsoft.AspNetCore.Mvc.IActionResult", "Contains", "http"),
        ("Source", "Attribute", "FromBody", "Contains", "http"),
        ("Source", "Attribute", "FromQuery", "Contains", "http"),
        ("Source", "Attribute", "FromForm", "Contains", "http"),
        ("Source", "Attribute", "FromRoute", "Contains", "http"),
        ("Sink", "Method", "Microsoft.AspNetCore.Mvc.ControllerBase.Redirect", "Contains", "redirect"),
        ("Sink", "Method", "Microsoft.AspNetCore.Mvc.ControllerBase.LocalRedirect", "Contains", "redirect"),
    ),
    "data": (
        ("Sink", "Method", "Dapper.SqlMapper.Query", "Contains", "sql"),
        ("Sink", "Method", "Dapper.SqlMapper.Execute", "Contains", "sql"),
        ("Sink", "Method", "Npgsql.NpgsqlCommand", "Contains", "sql"),
        ("Sanitizer", "Name", "AddWithValue", "Exact", "sql-parameterization"),
        ("Sanitizer", "Name", "Add", "Exact", "sql-parameterization"),
    ),
    "filesystem": (
        ("Sanitizer", "Method", "System.IO.Path.GetFileName", "Contains", "path-validation"),
        ("Sanitizer", "Method", "System.IO.Path.GetFullPath", "Contains", "path-normalization"),
    ),
    "serialization": (
        ("Sink", "Method", "Newtonsoft.Json.JsonConvert.DeserializeObject", "Contains", "deserialization"),
        ("Sink", "Method", "System.Text.Json.JsonSerializer.Deserialize", "Contains", "deserialization"),
        ("Sink", "Method", "YamlDotNet.Serialization.IDeserializer.Deserialize", "Contains", "deserialization"),
    ),
    "cloud": (
        ("Source", "Attribute", "QueueTrigger", "Contains", "serverless"),
        ("Source", "Attribute", "ServiceBusTrigger", "Contains", "serverless"),
        ("Source", "Attribute", "KafkaTrigger", "Contains", "serverless"),
    ),
    "rpc": (
        ("Source", "Namespace", "Orleans", "Prefix", "rpc"),
        ("Source", "Namespace", "Grpc", "Prefix", "rpc"),
    ),
    "auth": (
        ("Sink", "Name", "CreateToken", "Exact", "auth"),
        ("Sink", "Name", "SignInAsync", "Exact", "auth"),
        ("Sink", "Name", "GeneratePasswordResetTokenAsync", "Exact", "auth"),
    ),
    "crypto": (
        ("Source", "Code", "-----BEGIN", "Contains", "crypto-material"),
        ("Source", "Name", "key", "Contains", "crypto-material"),
        ("Source", "Name", "secret", "Contains", "secret"),
        ("Source", "Name", r"^(iv|IV|.*[a-z0-9]Iv|.*[_\.-](iv|IV))$", "Regex", "crypto-material"),
        ("Source", "Name", r"^(nonce|Nonce|NONCE|.*[a-z0-9]Nonce|.*[_\.-](nonce|Nonce|NONCE))$", "Regex", "crypto-material"),
        ("Sink", "Method", "System.Security.Cryptography", "Contains", "crypto"),
        ("Sink", "Method", "Microsoft.IdentityModel.Tokens", "Contains", "jwt"),
        ("Sink", "Method", "X509Certificate2", "Contains", "certificate"),
        ("Sink", "Code", "ServerCertificateCustomValidationCallback", "Contains", "tls"),
        ("Sanitizer", "Method", "System.Security.Cryptography.RandomNumberGenerator", "Contains", "secure-random"),
    ),
}


def matches(match: Column, pattern: Column, value: Column) -> Column:
    """Whether a text fits a pattern in a match mode."""
    v, p = F.lower(value), F.lower(pattern)
    return F.coalesce(
        F.when(match == "Contains", F.contains(v, p)).when(match == "Exact", v == p).when(match == "Prefix", F.startswith(v, p))
        .when(match == "Suffix", F.endswith(v, p)).when(match == "Regex", F.rlike(value, pattern)), F.lit(False))


def rule_rows(packs: Iterable[str] = ()) -> list[tuple]:
    """The defaults, always on, and the packs asked for; ``all`` or none named is all of them."""
    wanted = [p.lower() for p in packs]
    wanted = list(PACKS) if not wanted or "all" in wanted else wanted
    rows = [(t, *r, None) for t, rules in (("Source", SOURCES), ("Sink", SINKS), ("Passthrough", PASSTHROUGHS), ("Sanitizer", SANITIZERS)) for r in rules]
    rows += [(*r, p) for p in PACKS if p in wanted for r in PACKS[p]]
    return [(i, t, kind, match, pattern, category, pack) for i, (t, kind, pattern, match, category, pack) in enumerate(rows)]


def rules(spark: SparkSession, packs: Iterable[str] = (), user: DataFrame | None = None) -> DataFrame:
    """The rule table; rules of ``user`` come after the others."""
    rows = rule_rows(packs)
    own = spark.createDataFrame(rows, RULE_SCHEMA)
    return own if user is None else own.unionByName(user.withColumn("ord", F.col("ord") + len(rows)), allowMissingColumns=True)


def user_rules(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file of sources, sinks, passthroughs and sanitizers; each list sets its rules' target."""
    doc = spark.read.option("multiLine", True).json(path)
    parts = None
    for name, target in (("sources", "Source"), ("sinks", "Sink"), ("passthroughs", "Passthrough"), ("sanitizers", "Sanitizer")):
        column = next((c for c in doc.columns if c.lower() == name), None)
        if column is None:
            continue
        one = doc.select(F.posexplode(column).alias("ord", "r"))
        if not isinstance(one.schema["r"].dataType, T.StructType):  # an empty list
            continue
        fields = {f.name.lower(): f.name for f in one.schema["r"].dataType}
        get = lambda k, d=None, fields=fields: F.col(f"r.{fields[k]}") if k in fields else F.lit(d)
        one = one.select("ord", F.lit(target).alias("target"), get("kind", "Method").alias("kind"), F.coalesce(get("match"), F.lit("Contains")).alias("match"),
                         get("pattern").alias("pattern"), get("category").cast("string").alias("category"), F.lit("user").alias("pack"))
        parts = one if parts is None else parts.unionByName(one)
    return parts if parts is not None else spark.createDataFrame([], RULE_SCHEMA)


def matched(rows: DataFrame, texts: dict[str, str | Column], table: DataFrame) -> DataFrame:
    """Each row with each rule that one of its texts fits; ``texts`` gives the text that a rule's kind tests."""
    stacked = F.array(*[F.struct(F.lit(k).alias("kind"), (F.col(v) if isinstance(v, str) else v).cast("string").alias("_text")) for k, v in texts.items()])
    long = rows.withColumn("_t", F.explode(stacked)).select(*rows.columns, "_t.kind", "_t._text")
    return long.join(F.broadcast(table), "kind").filter(matches(F.col("match"), F.col("pattern"), F.col("_text"))).drop("_text")


def first_match(rows: DataFrame, key: list[str], texts: dict[str, str | Column], table: DataFrame) -> DataFrame:
    """For each row the first rule in the table's order that fits."""
    found = matched(rows, texts, table).groupBy(*key).agg(F.min_by(F.struct("ord", "pattern", "category"), "ord").alias("rule"))
    return rows.join(found, key, "left")


def code_like(table: DataFrame) -> DataFrame:
    """Rules that are tried on code text."""
    return table.filter(F.col("kind").isin("Code", "Method", "Symbol", "Name"))


def instruction_like(table: DataFrame) -> DataFrame:
    """Rules for members of compiled code: no code, parameter or attribute sources, no short contained names."""
    out = table.filter((F.col("kind") != "Code") & ~((F.col("target") == "Source") & F.col("kind").isin("Parameter", "Attribute")))
    return out.filter(~((F.col("kind") == "Name") & (F.col("match") == "Contains") & (F.length("pattern") < 4)))


def source_file(path: Column) -> Column:
    """Paths of nine kinds of source files."""
    return F.coalesce(F.lower(path).rlike(r"\.(cs|csx|vb|fs|fsi|fsx|r|rmd|qmd)$"), F.lit(False))


def high_risk(confidence: Column, sink_category: Column) -> Column:
    """P13."""
    return F.coalesce((confidence == "High") | sink_category.isin("command", "sql", "file", "deserialization"), F.lit(False))


def rank_in_order(df: DataFrame, key: list[str], order: list, name: str = "_n") -> DataFrame:
    """A4: rows numbered within their key, in a total order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
