"""Label canonicalisation as built-in expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical spelling of each known class, by lower-case spelling.
CANONICAL_LABELS = {
    "benign": "Benign",
    "dos hulk": "DoS Hulk",
    "dos goldeneye": "DoS GoldenEye",
    "dos slowloris": "DoS slowloris",
    "dos slowhttptest": "DoS Slowhttptest",
    "dosslowhttptest": "DoS Slowhttptest",
    "ftp-patator": "FTP-Patator",
    "ssh-patator": "SSH-Patator",
    "web attack � brute force": "Web Attack � Brute Force",
    "web attack � xss": "Web Attack � XSS",
    "web attack � sql injection": "Web Attack � Sql Injection",
    "infiltration": "Infiltration",
    "heartbleed": "Heartbleed",
    "bot": "Bot",
    "ddos": "DDoS",
    "portscan": "PortScan",
}
MISSING_LABEL = "NaN"
BENIGN_ALIASES = ("benign",)
BACKGROUND_ALIASES = ("background",)

_BLANKS = " \t\n\r\x0b\x0c"


def strip(column: Column) -> Column:
    return F.btrim(column, F.lit(_BLANKS))


def canonical_label(column: Column) -> Column:
    text = strip(column.cast("string"))
    key = F.lower(text)
    known = F.create_map(*[F.lit(v) for v in chain.from_iterable(CANONICAL_LABELS.items())])
    web = F.when(
        key.contains("web attack"),
        F.when(key.contains("brute"), F.lit("Web Attack � Brute Force"))
        .when(key.contains("xss"), F.lit("Web Attack � XSS"))
        .when(key.contains("sql") | key.contains("injection"), F.lit("Web Attack � Sql Injection")),
    )
    return (
        F.when(column.isNull(), F.lit(MISSING_LABEL))
        .when(text == "", F.lit(""))
        .otherwise(F.coalesce(F.try_element_at(known, key), web, text))
    )


def binary_label(canonical: Column, benign_aliases=BENIGN_ALIASES, blank_is_missing: bool = True) -> Column:
    """0 benign, 1 attack, NULL unknown. A blank label is unknown unless told otherwise."""
    aliases = sorted({a.strip().lower() for a in benign_aliases})
    unknown = canonical.isNull() | (canonical == MISSING_LABEL)
    if blank_is_missing:
        unknown = unknown | (canonical == "")
    return F.when(unknown, F.lit(None)).otherwise(
        F.when(F.lower(canonical).isin(aliases), 0).otherwise(1)
    ).cast("int")
