"""Text to values: labels, ids, sequences, log and column names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Column names accepted for ids and for sequences, in order of preference.
ID_COLUMN_NAMES = ("uniprot_id", "uniprotid", "protein_id", "protein", "id", "accession")
SEQUENCE_COLUMN_NAMES = ("sequence", "seq", "protein_sequence")
# Words written in capitals in log labels.
LABEL_ACRONYMS = ("auc", "auprc", "csv", "ddp", "lr")

# What counts as blank around and inside fields.
BLANKS = " \t\n\r\f\v"


def strip_blanks(value: Column) -> Column:
    return F.btrim(value, F.lit(BLANKS))


def label_value(text: Column) -> Column:
    """Number in ``text``, cut towards zero, as INT; NULL when it is not a finite number."""
    number = strip_blanks(text).try_cast("double")
    return F.when(F.isnan(number), None).otherwise(number.try_cast("int"))


def clean_sequence(text: Column) -> Column:
    """Upper case, without gap signs (dash, dot, star) and blanks."""
    return F.regexp_replace(F.upper(text), r"(?U)[-.*\s]", "")


def truncated_sequence(text: Column, max_length: int) -> Column:
    """First ``max_length`` letters; an empty sequence becomes NULL."""
    kept = F.substring(text, 1, max_length)
    return F.when(F.length(kept) > 0, kept)


def header_id(header: Column) -> Column:
    """Text between the first two pipes, or else the first word."""
    piped = F.regexp_extract(header, r"\|([^|]+)\|", 1)
    word = F.regexp_extract(header, r"(\S+)", 1)
    return F.when(piped != "", strip_blanks(piped)).otherwise(word)


def content_key(value: Column) -> Column:
    return F.sha2(value.cast("string"), 256)


def resolve_column(
    columns: Sequence[str], override: str | None, candidates: Sequence[str], kind: str = "id"
) -> str | None:
    """Actual name of the wanted column, whatever its case; an override has to exist."""
    by_lower = {name.lower(): name for name in columns}
    if override is not None:
        if override.lower() not in by_lower:
            raise ValueError(f"no {kind} column named {override!r} among {list(columns)}")
        return by_lower[override.lower()]
    return next((by_lower[c] for c in candidates if c in by_lower), None)


def metric_header(name: Column) -> Column:
    """``val_auprc`` or ``AUPRC`` to the step-table header ``Val auprc``."""
    plain = F.regexp_replace(F.lower(strip_blanks(name)), " ", "_")
    return F.concat(F.lit("Val "), F.regexp_replace(plain, "^val_", ""))


def log_label(token: Column) -> Column:
    """``val_auprc`` to ``Val AUPRC``."""
    words = F.filter(F.split(F.regexp_replace(token, "-", "_"), "_"), lambda w: w != "")
    shown = F.transform(
        words,
        lambda w: F.when(F.lower(w).isin(*LABEL_ACRONYMS), F.upper(w)).otherwise(
            F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))
        ),
    )
    return F.array_join(shown, " ")


def log_event(event: Column, fields: Column) -> Column:
    """Log line body from an event name and a map of already printed field values."""
    entries = F.array_sort(F.map_entries(fields))
    parts = F.transform(entries, lambda e: F.concat_ws(": ", log_label(e["key"]), e["value"]))
    return F.array_join(F.concat(F.array(log_label(event)), parts), " | ")


def printed_float(value: Column, digits: int = 4) -> Column:
    """The number with so many decimals; a value exactly half way goes to the even neighbour."""
    halves = F.abs(value) * float(2 ** (digits + 1))
    half_way = halves % 2.0 == 1.0
    return F.format_string(
        f"%.{digits}f", F.when(half_way, F.bround(value, digits)).otherwise(value)
    )
