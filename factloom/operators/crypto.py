"""Cryptographic facts (E17, P15, A8, J10-J12): classification, findings and correlation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.scalars import has
from factloom.operators.aggregates import upsert

#: Tokens, algorithm, family, strength, operation, rule, severity; the first that fits.
CLASSES = (
    (("MD5", "EVP_md5", "digest::digest"), "MD5", "hash", "weak", "use", "CRYPTO-WEAK-HASH-MD5", "High"),
    (("SHA1", "SHA1CryptoServiceProvider", "EVP_sha1"), "SHA-1", "hash", "weak", "use", "CRYPTO-WEAK-HASH-SHA1", "Medium"),
    (("DES", "TripleDES", "RC2", "EVP_des", "EVP_rc4"), "DES/RC2/RC4", "symmetric", "weak", "use", "CRYPTO-WEAK-CIPHER", "High"),
    (("AesGcm", "AES_gcm", "EVP_aes_256_gcm"), "AES-GCM", "symmetric", "strong", "encrypt/decrypt", None, None),
    (("AesCcm", "AES_ccm"), "AES-CCM", "symmetric", "strong", "encrypt/decrypt", None, None),
    (("Aes", "AES_", "EVP_aes"), "AES", "symmetric", "acceptable", "encrypt/decrypt", None, None),
    (("RSA", "RSA_"), "RSA", "asymmetric", "acceptable", "sign/encrypt", None, None),
    (("ECDsa", "ECDSA"), "ECDSA", "asymmetric", "strong", "sign", None, None),
    (("ECDiffieHellman", "ECDH"), "ECDH", "key-agreement", "strong", "key-agreement", None, None),
    (("SHA256", "SHA384", "SHA512", "EVP_sha256", "EVP_sha512"), "SHA-2", "hash", "strong", "use", None, None),
    (("HMACSHA256", "HMACSHA384", "HMACSHA512", "HMAC("), "HMAC", "mac", "strong", "mac", None, None),
    (("Rfc2898DeriveBytes", "PKCS5_PBKDF2_HMAC"), "PBKDF2", "kdf", "acceptable", "key-derivation", None, None),
    (("RandomNumberGenerator", "RNGCryptoServiceProvider", "RAND_bytes"), "CSPRNG", "random", "strong", "random", None, None),
    (("System.Random", "Random", "rand", "srand"), "Non-cryptographic RNG", "random", "weak", "random", "CRYPTO-INSECURE-RNG", "Medium"),
    (("X509Certificate2", "X509_STORE", "CertificateRequest"), "X.509", "certificate", "unknown", "certificate", None, None),
    (("SslStream", "SSL_CTX", "SslProtocols", "TLS"), "TLS", "protocol", "acceptable", "transport-security", None, None),
    (("SecurityAlgorithms.None",), "JWT none", "signature", "weak", "sign", "CRYPTO-JWT-NONE", "High"),
    (("openssl::", "sodium::", "digest::"), None, "library", "unknown", "library", None, None),
)
#: Namespaces below which a token may stand anywhere in the symbol.
FRAMEWORK = ("System.Security.Cryptography", "System.Security.Authentication", "System.Net.Security", "Microsoft.IdentityModel")


def token_pattern(tokens: tuple[str, ...]) -> str:
    """A token, or a token and a delimiter; short tokens before digits; TLS before a version."""
    ends = []
    for token in tokens:
        more = r"$|[._]|::" + (r"|\d" if len(token) <= 3 else "") + (r"|v(?:$|[\d_.:])" if token.upper() == "TLS" else "")
        ends.append(f"{re.escape(token)}(?:{more})")
    return rf"(?i)^(?:System\.)?(?:{'|'.join(ends)})"


def has_token(symbol: Column, tokens: tuple[str, ...]) -> Column:
    """At the start, or anywhere for scoped tokens and below the frameworks' namespaces."""
    inside = lambda names: "(?i)" + "|".join(map(re.escape, names))
    scoped = [x for x in tokens if "_" in x or "::" in x]
    out = symbol.rlike(token_pattern(tokens)) | (symbol.rlike(inside(FRAMEWORK)) & symbol.rlike(inside(tokens)))
    return out | symbol.rlike(inside(scoped)) if scoped else out


def classify(rows: DataFrame, symbol: str = "symbol", code: str = "code") -> DataFrame:
    """Rows with a cryptographic symbol, and its class."""
    s, fields = F.col(symbol), ("algorithm", "family", "strength", "operation", "rule", "severity")
    quoted = {"MD5": has(F.col(code), 'algo = "md5"'), "SHA-1": has(F.col(code), 'algo = "sha1"')}
    found = F.lit(None)
    for tokens, algorithm, *rest in reversed(CLASSES):
        name = F.lit(algorithm) if algorithm else s
        if algorithm == "DES/RC2/RC4":
            name = F.when(has(s, "Triple"), "3DES").otherwise(name)
        elif algorithm == "SHA-2":
            name = F.when(F.contains(s, F.lit("512")), "SHA-512").otherwise(name)
        one = F.struct(name.alias("algorithm"), *[F.lit(v).cast("string").alias(k) for k, v in zip(fields[1:], rest, strict=True)])
        found = F.when(has_token(s, tokens) | quoted.get(algorithm, F.lit(False)), one).otherwise(found)
    return rows.withColumn("_c", found).filter(F.col("_c").isNotNull()).select(*rows.columns, *[F.col(f"_c.{f}").alias(f) for f in fields])


def assets(classified: DataFrame) -> DataFrame:
    """One asset per algorithm and place."""
    one = classified.withColumns({"ord": F.struct("line", "symbol"), "symbols": F.array("symbol")})
    return upsert(one, ["algorithm", "path", "line"], ["family", "strength"], [], ["symbols"], "ord")


def findings(found: DataFrame) -> DataFrame:
    """One finding per rule and place."""
    return upsert(found.withColumn("ord", F.col("column")), ["rule", "path", "line"], ["severity", "column"], [], [], "ord")


def evidence_links(findings_: DataFrame, others: DataFrame) -> DataFrame:
    """Distinct (finding_id, other_id) at the same place or with a slice in common."""
    place = findings_.join(others, ["path", "line"]).select("finding_id", "other_id")
    a, b = findings_.select("finding_id", F.explode("slice_ids").alias("s")), others.select("other_id", F.explode("slice_ids").alias("s"))
    return place.unionByName(a.join(b, "s").select("finding_id", "other_id")).distinct()


def dependencies(operations: DataFrame, materials: DataFrame) -> DataFrame:
    """K9: each operation with the sorted materials that share a slice with it."""
    a, b = operations.select("operation_id", F.explode("slice_ids").alias("s")), materials.select("material_id", F.explode("slice_ids").alias("s"))
    return a.join(b, "s").groupBy("operation_id").agg(F.array_sort(F.collect_set("material_id")).alias("depends_on"))
