"""Fill-in-middle by escaped marker injection, in DataFrame functions.

A text is cut into units (``[A-Za-z]+|[^A-Za-z]``, left to right over code points).  A delimiter that the text may
itself hold is escaped first; ``regexp_replace`` then puts the delimiter behind every unit (an escape sequence is
one unit), so units are counted by counting delimiters, and ``substring_index`` takes the ranked parts.  Dropping the
delimiters and undoing the escapes gives the parts of the text back, which are assembled to the form's output.

Where a document is cut, and its form, follow from digests of ``seed:doc_id`` alone, so a rerun, another
partitioning or a lost executor changes nothing.  There is no shuffle; a row needs memory for a few copies of its text.

Defined cases: a null text is empty and an empty text is plain; a text that holds a marker stays plain, so an output
is always read back without doubt; a null doc_id is written as nothing (``1:``); repeated rows give repeated rows; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Puts an end to each unit; texts may hold it, so it is escaped.
DELIMITER, ESCAPE = "\x1f", "\x1e"
#: Escape sequences of the escape character and of the delimiter; neither second character is a letter.
SEQUENCES = ((ESCAPE, ESCAPE + "0"), (DELIMITER, ESCAPE + "1"))
UNIT = f"{ESCAPE}[01]|[A-Za-z]+|[^A-Za-z]"


def _swap(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def mark(text: Column) -> Column:
    """The text with the delimiter behind every unit."""
    for plain, written in SEQUENCES:
        text = _swap(text, plain, written)
    return F.regexp_replace(text, f"({UNIT})", f"$1{DELIMITER}")


def unmark(marked: Column) -> Column:
    """The text of a marked one, or of a part of it that ends between units."""
    text = _swap(marked, DELIMITER, "")
    for plain, written in reversed(SEQUENCES):
        text = _swap(text, written, plain)
    return text


def units(marked: Column) -> Column:
    """The number of units: of delimiters."""
    return (F.length(marked) - F.length(_swap(marked, DELIMITER, ""))).cast("long")


def _ranked(marked: Column, count: Column) -> Column:
    """The first units of a marked text; from the end if ``count`` is negative."""
    return F.call_function("substring_index", marked, F.lit(DELIMITER), count.cast("int"))


def assemble(form: Column, prefix: Column, middle: Column, suffix: Column, text: Column) -> Column:
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def restore(output: Column, form: Column) -> Column:
    """The very text, from an output and its form alone.

    A marker starts with ``<`` and ends with ``>``, and no part holds one, so none arises where parts meet markers.
    """
    first = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))  # ends the first part
    head = F.call_function("substring", F.call_function("substring_index", output, first, F.lit(1)), F.lit(len(PREFIX) + 1))
    tail = F.call_function("substring_index", output, F.lit(MIDDLE), F.lit(-1))
    inner = F.call_function("substring_index", F.call_function("substring_index", output, F.lit(MIDDLE), F.lit(1)), first, F.lit(-1))
    return F.when(form == "psm", F.concat(head, tail, inner)).when(form == "spm", F.concat(inner, tail, head)).otherwise(output)


def transform(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """One row ``(doc_id, n, form, prefix, middle, suffix, output)`` per document.

    Of 100 values of the third digest group those from ``plain_from`` on leave a text plain; of the fourth those
    below ``spm_below`` put the suffix first.  Parts are null where the form is plain.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    group = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}")
    rows = docs.select("doc_id", text.alias("text"), *(group(k) for k in range(4)))
    rows = rows.withColumn("marked", mark(F.col("text"))).withColumn("n", units(F.col("marked")))
    a, b = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    holds = [F.contains("text", F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)]
    plain = (F.col("text") == "") | holds[0] | holds[1] | holds[2] | (F.col("h3") % 100 >= plain_from)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_below, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "marked", "n", F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), form.alias("form"))
    cut = F.col("form") != "plain"
    upto = _ranked(F.col("marked"), F.col("b"))
    prefix = F.when(cut, unmark(_ranked(F.col("marked"), F.col("a"))))
    middle = F.when(cut, F.when(F.col("a") == F.col("b"), "").otherwise(unmark(_ranked(upto, F.col("a") - F.col("b")))))
    suffix = F.when(cut, unmark(_ranked(F.col("marked"), F.col("b") - F.col("n") - 1)))
    rows = rows.select("doc_id", "n", "form", "text", prefix.alias("prefix"), middle.alias("middle"), suffix.alias("suffix"))
    output = assemble(F.col("form"), F.col("prefix"), F.col("middle"), F.col("suffix"), F.col("text"))
    # A row of its own per example keeps a later filter on the output from being computed from the text once more.
    example = F.struct("n", "form", "prefix", "middle", "suffix", output.alias("output"))
    return rows.select("doc_id", F.inline(F.array(example)))


def digest(examples: DataFrame) -> DataFrame:
    """Sizes of the parts, and digests of the outputs and of the texts read back from them."""
    length = lambda name: F.length(name).cast("long").alias(f"{name}_chars")
    back = restore(F.col("output"), F.col("form"))
    return examples.select("doc_id", "n", "form", length("prefix"), length("middle"), F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
