"""De-identification of header tables, keyed hashing, authenticated encryption."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cohort.functions.keyed import hmac_sha256

# Header fields that are blanked and fields that are hashed by default.
REMOVE_TAGS = (
    "PatientName", "PatientID", "PatientBirthDate", "PatientSex", "PatientAge",
    "PatientAddress", "PatientTelephoneNumbers", "ReferringPhysicianName",
    "ReferringPhysicianAddress", "ReferringPhysicianTelephoneNumbers", "InstitutionName",
    "InstitutionAddress", "InstitutionalDepartmentName", "PhysiciansOfRecord",
    "PerformingPhysicianName", "OperatorsName", "OtherPatientIDs", "OtherPatientNames",
    "MedicalRecordLocator", "EthnicGroup", "Occupation", "AdditionalPatientHistory",
    "PatientComments", "RequestingPhysician", "ScheduledPerformingPhysicianName",
)
HASH_TAGS = ("StudyInstanceUID", "SeriesInstanceUID", "SOPInstanceUID", "AccessionNumber",
             "StudyID")
UID_ROOT = "2.25."
UID_DIGITS = 60
SALT_BYTES = 16
KEY_BYTES = 32
KEY_ROUNDS = 100_000


def keyed_uid(value: Column, salt: str, uid_mode: str = "hex") -> Column:
    """Linkable pseudonym of an identifier under a secret salt.

    ``hex`` keeps the published format (60 hex digits after the root); ``decimal`` gives a legal
    numeric identifier made of the first 60 bits.
    """
    if not salt:
        raise ValueError("a salt is required; without it values cannot be linked across runs")
    digest = hmac_sha256(salt, value)
    if uid_mode == "hex":
        return F.concat(F.lit(UID_ROOT), F.substring(digest, 1, UID_DIGITS))
    if uid_mode == "decimal":
        return F.concat(F.lit(UID_ROOT), F.conv(F.substring(digest, 1, 15), 16, 10))
    raise ValueError(f"unknown uid_mode {uid_mode!r}")


def deidentify_columns(df: DataFrame, salt: str, remove: Sequence[str] = (),
                       hash_: Sequence[str] = (), uid_mode: str = "hex") -> DataFrame:
    """Blank and hash plain columns; NULL stays NULL because the field is not there."""
    blank = {c: F.when(F.col(c).isNotNull(), F.lit("")) for c in remove}
    hashed = {c: keyed_uid(F.col(c).cast("string"), salt, uid_mode) for c in hash_}
    return df.withColumns({**blank, **hashed})


def deidentify_tags(df: DataFrame, salt: str, remove: Sequence[str] = REMOVE_TAGS,
                    hash_: Sequence[str] = HASH_TAGS, tags: str = "tags",
                    uid_mode: str = "hex") -> DataFrame:
    """Rewrite a tag map and report per row what changed.

    Adds ``removed`` (tag, original length), ``hashed`` (tag, prefixes) and ``error``; a row
    without a tag map keeps its place and says so.
    """
    def new_value(tag, value):
        return (F.when(tag.isin(*remove), F.lit(""))
                .when(tag.isin(*hash_), keyed_uid(value, salt, uid_mode)).otherwise(value))

    entries = F.map_entries(tags)
    removed = F.transform(F.filter(entries, lambda e: e["key"].isin(*remove)), lambda e: F.struct(
        e["key"].alias("tag"), F.length(e["value"]).alias("original_length")))
    hashed = F.transform(F.filter(entries, lambda e: e["key"].isin(*hash_)), lambda e: F.struct(
        e["key"].alias("tag"),
        F.concat(F.substring(e["value"], 1, 8), F.lit("...")).alias("original_prefix"),
        F.concat(F.substring(keyed_uid(e["value"], salt, uid_mode), 1, 16), F.lit("..."))
        .alias("hashed_prefix")))
    return df.select(
        *[c for c in df.columns if c != tags],
        F.transform_values(tags, new_value).alias(tags), removed.alias("removed"),
        hashed.alias("hashed"),
        F.when(F.col(tags).isNull(), "header could not be read").alias("error"))


def linkage_counts(left: DataFrame, right: DataFrame, left_key: str, right_key: str
                   ) -> DataFrame:
    """Joined rows and linked keys between two tables, to compare before and after hashing.

    Keys are counted on each side first, so a key with many rows is one row in the join.
    """
    a = left.groupBy(F.col(left_key).alias("_key")).agg(F.count("*").alias("_a"))
    b = right.groupBy(F.col(right_key).alias("_key")).agg(F.count("*").alias("_b"))
    return a.join(b, "_key").agg(
        F.coalesce(F.sum(F.col("_a") * F.col("_b")), F.lit(0)).alias("joined_rows"),
        F.count("*").alias("linked_keys"))


def derive_key(password: str, salt: bytes) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, KEY_ROUNDS, KEY_BYTES)


def derived_keys(salt: Column, password: str) -> Column:
    """Key of each row's salt.  A task derives a salt it has seen only once."""
    @F.pandas_udf(T.BinaryType())
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        @lru_cache(maxsize=1024)
        def key(salt_bytes: bytes) -> bytes:
            return derive_key(password, salt_bytes)

        for batch in batches:
            yield pd.Series([None if s is None else key(bytes(s)) for s in batch], dtype=object)

    return keys(salt)


def encrypt(df: DataFrame, column: str, password: str, per_row_salt: bool = False) -> DataFrame:
    """Replace a column by its encrypted blob: salt, nonce, ciphertext, tag.

    By default one fresh salt serves the whole write, so the slow key derivation runs once;
    nonces are fresh per value either way.  ``per_row_salt`` derives a key per row.
    """
    data = F.col(column).cast("binary")
    if per_row_salt:
        salted = df.withColumn("_salt", F.unhex(F.replace(F.uuid(), F.lit("-"), F.lit(""))))
        keyed = salted.withColumn("_aes", derived_keys(F.col("_salt"), password))
        return keyed.withColumn(column, F.concat(
            F.col("_salt"), F.aes_encrypt(data, F.col("_aes"), F.lit("GCM")))).drop(
            "_salt", "_aes")
    salt = os.urandom(SALT_BYTES)
    key = F.lit(bytearray(derive_key(password, salt)))
    return df.withColumn(column, F.concat(F.lit(bytearray(salt)),
                                          F.aes_encrypt(data, key, F.lit("GCM"))))


def decrypt(df: DataFrame, column: str, password: str, strict: bool = True) -> DataFrame:
    """Undo :func:`encrypt`.  Tampering or a wrong password fails; ``strict=False`` gives NULL."""
    salt = F.substring(F.col(column), 1, SALT_BYTES)
    body = F.expr(f"substring({column}, {SALT_BYTES + 1})")
    keyed = df.withColumn("_aes", derived_keys(salt, password))
    opened = F.aes_decrypt if strict else F.try_aes_decrypt
    return keyed.withColumn(column, opened(body, F.col("_aes"), F.lit("GCM"))).drop("_aes")
