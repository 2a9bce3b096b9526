"""Texts that were cut off before their own end.

Two kinds of cuts are looked for: at a field's limit, which shows as a spike in
the histogram of lengths (in characters or in bytes) of its source, and in the
middle of a transfer, at any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspike.functions.cells import BLANKS
from marlspike.session import durable

# Marks a system puts behind a cut, terminal punctuation, closing marks.
_MARK = r"\s*(\.\.\.|…|\[(\.\.\.|…|\p{Ll}{2,12})\]|\((\.\.\.|…|\p{Ll}{2,12})\))$"
_ELLIPSIS = r"(\.\.\.)$"
_CLOSERS = r"[\"'”’»)\]」』*_`]*"
_TERMINAL = r"[.!?。！？…]" + _CLOSERS + "$"
_UP_TO_SENTENCE = r"^.*([.!?]" + _CLOSERS + r"\s+|[。！？]" + _CLOSERS + r"\s*)(?=\S)"
_FOOTER = r"([\r\n]+\s*-- [^\r\n]*)+$"
_TURN = r"^\[\d{1,2}:\d{2}\] \w+: "
_REFERENCE = r"^\p{L}+ \p{Lu}+-\d{3,}$"
_LABEL = r"^[^.!?:]{1,80}: (.*\d%|.*\p{Lu}/\p{Lu}{3,})$"

#: Word-wise cutters stop up to this many characters before the limit.
BACK_OFF = 12


def _form(line: Column) -> Column:
    """A line with numbers, codes and ids masked, so that equal forms compare equal."""
    out = F.regexp_replace(line, _TURN, "")
    out = F.regexp_replace(out, r"\b[\p{Lu}\d]{8,}\b", "§")
    out = F.regexp_replace(out, r"\b\p{Lu}{2,12}/", "¤/")
    return F.regexp_replace(out, r"\d+", "0")


def text_endings(docs: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    """How each text ends: one row per document with a text that isn't blank.

    Columns: id, source, ``chars`` and ``bytes`` (length without what was put
    behind a break: white space, attribution lines, continuation marks), ``mark``
    (continuation mark or empty), ``fragment`` (masked text after the last
    sentence end of the last line), ``state``: 'closed' ends with terminal
    punctuation or a complete structure, 'broken' is certainly inside one
    (half a character, open code fence, unbalanced JSON line), 'open' is neither.
    ``forms`` are the masked inner lines without terminal punctuation.
    """
    blanks = F.lit(BLANKS)
    t = F.rtrim(F.col(text), blanks)
    base = docs.select(
        F.col(doc_id).alias("id"), F.col(source).alias("source"), t.alias("t")
    ).filter(F.length("t") > 0)
    footer = F.regexp_extract("t", _FOOTER, 0)
    base = base.select("id", "source", "t", footer.alias("footer"))
    cut_footer = (F.length("footer") > 0) & ~F.col("footer").rlike(r"\d$") & ~F.col("footer").rlike(_TERMINAL)
    stripped = F.when(
        (F.length("footer") > 0) & ~cut_footer & (F.length("footer") < F.length("t")),
        F.rtrim(F.expr("substr(t, 1, length(t) - length(footer))"), blanks),
    ).otherwise(F.col("t"))
    base = base.select("id", "source", cut_footer.alias("cut_footer"), stripped.alias("t"))
    mark = F.regexp_extract("t", _MARK, 0)
    base = base.select("id", "source", "cut_footer", "t", mark.alias("mark"))
    body = F.expr("substr(t, 1, length(t) - length(mark))")
    base = base.select("id", "source", "cut_footer", "t", "mark", body.alias("b"))
    lines = F.transform(F.split("b", r"[\r\n]+"), lambda x: F.btrim(x, blanks))
    base = base.select("id", "source", "cut_footer", "mark", "b", F.filter(lines, lambda x: x != "").alias("lines"))
    last = F.coalesce(F.get("lines", F.size("lines") - 1), F.lit(""))
    base = base.select("id", "source", "cut_footer", "mark", "b", "lines", last.alias("last"))

    def count(of: Column, what: str) -> Column:
        return F.length(of) - F.length(F.replace(of, F.lit(what), F.lit("")))

    raw = F.regexp_replace(F.regexp_replace("last", _TURN, ""), _UP_TO_SENTENCE, "")
    open_fence = (count(F.col("b"), "```") % 2 == 1) & F.col("b").contains("```")
    json_line = F.col("last").startswith("{")
    balanced = (
        (count(F.col("last"), "{") == count(F.col("last"), "}"))
        & (count(F.col("last"), "[") == count(F.col("last"), "]"))
        & (count(F.col("last"), '"') % 2 == 0)
    )
    whole_structure = (
        (F.col("last").endswith("```") & ~open_fence)
        | (json_line & balanced & F.col("last").endswith("}"))
        | raw.rlike(r"^\([^()]*\)$")
        | raw.rlike(_LABEL)
        | F.col("last").rlike(_REFERENCE)
        | ~raw.rlike(r"[\p{L}\d]")
    )
    # a reply in a conversation, or a note of one word, needs no full stop
    short = r"^\p{Ll}[^.]{0,40}$"
    reply = (F.col("last").rlike(_TURN) & (raw.rlike(short) | raw.rlike(r"^\p{Lo}{1,10}$"))) | (
        (F.size("lines") == 1) & (F.col("last").rlike(r"^\p{L}+$") | F.col("last").rlike(short))
    )
    # a heading or an opening line announces what isn't there any more
    announced = (F.size("lines") > 1) & (F.col("last").rlike(r"^#{1,6} ") | F.col("last").rlike("[:：]$"))
    broken = F.col("cut_footer") | announced | F.col("b").endswith("�") | open_fence | (json_line & ~balanced)
    state = (
        F.when(broken, "broken")
        .when((F.col("mark") == "") & (F.col("b").rlike(_TERMINAL) | whole_structure), "closed")
        .when((F.col("mark") != "") & F.col("b").rlike(_TERMINAL), "closed")
        .otherwise("open")
    )
    inner = F.filter(
        F.slice("lines", 1, F.greatest(F.size("lines") - 1, F.lit(0))),
        lambda x: ~x.rlike(_TERMINAL) & ~x.startswith("{"),
    )
    return base.select(
        "id", "source", F.length("b").alias("chars"), F.octet_length("b").alias("bytes"),
        "mark", _form(raw).alias("fragment"), state.alias("state"), reply.alias("reply"),
        F.array_distinct(F.transform(inner, _form)).alias("forms"),
    )


def length_spikes(ends: DataFrame, least: int = 3, factor: float = 4.0, share: float = 0.02) -> DataFrame:
    """(source, unit, spike, n, at_maximum): lengths at which a source's unfinished texts pile up.

    ``ends`` has source, chars, bytes and ``unfinished``. Per source and unit the
    histogram of unfinished texts is tested at every length: at least ``least``
    texts, a ``share`` of all of the source's, and ``factor`` times what its surroundings (50 lengths either way,
    without those a word-wise cutter leaves just below) would let expect. A pile
    just below a larger one is that one's; of a length that piles up in both
    units, the unit with more texts has the limit (the others are texts in which
    both lengths agree). ``at_maximum``: no unfinished text of the source is
    longer (but for two that a cutter adds); the other piles are limits of
    single fields or senders. The histogram has as many rows as there are
    different lengths.
    """
    long = ends.filter("unfinished").select(
        "source",
        F.explode(
            F.array(
                F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")),
                F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")),
            )
        ).alias("x"),
    )
    histogram = long.groupBy("source", "x.unit", "x.length").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("source", "unit").orderBy("length")
    around = F.coalesce(F.sum("n").over(by.rangeBetween(-50, -BACK_OFF - 1)), F.lit(0)) + F.coalesce(
        F.sum("n").over(by.rangeBetween(3, 50)), F.lit(0)
    )
    expected = around / F.lit(50 - BACK_OFF + 48)
    above = F.coalesce(F.max("n").over(by.rangeBetween(1, BACK_OFF)), F.lit(0))
    all_ = Window.partitionBy("source", "unit")
    whole, longest = F.sum("n").over(all_), F.max("length").over(all_)
    piles = histogram.withColumns({"expected": expected, "above": above, "whole": whole, "longest": longest}).filter(
        (F.col("n") >= least) & (F.col("n") >= F.lit(share) * F.col("whole")) & (F.col("n") >= F.lit(factor) * F.col("expected")) & (F.col("n") >= F.col("above"))
    )
    better = Window.partitionBy("source", "length").orderBy(F.col("n").desc(), F.col("unit").desc())
    return piles.withColumn("r", F.row_number().over(better)).filter("r = 1").select(
        "source", "unit", F.col("length").alias("spike"), "n", (F.col("longest") <= F.col("length") + 2).alias("at_maximum")
    )


def truncated_texts(docs: DataFrame, doc_id: str, source: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(found, spikes). found: id, source, reason, limit_length, limit_unit for every cut text.

    Reasons: 'limit' at (or up to ``BACK_OFF`` below) a spike of its source,
    'transfer' anywhere else. A text is cut if what remains after white space,
    attribution lines and continuation marks were taken off breaks off inside a
    structure, or has no terminal punctuation and its last fragment isn't a form
    that also stands complete inside other texts (list items, replies). A plain
    ellipsis that is away from every spike of a source that has spikes, or whose
    fragment also ends texts away from spikes, is the author's own. Null and blank texts are no case. A
    null source is a source of its own. Equal texts get equal answers.

    Every text is read whole, JVM-side; shuffled are masked forms (one per
    distinct form), histograms and the unfinished texts' keys.
    """
    # read again below: what is kept of a text is short
    ends = durable(text_endings(docs, doc_id, source, text), "endings")
    forms = ends.select(F.explode("forms").alias("fragment")).groupBy("fragment").agg(F.count(F.lit(1)).alias("inside"))
    # only what isn't closed can be a case: a few percent go on
    undecided = ends.filter(F.col("state") != "closed").drop("forms")
    judged = undecided.join(forms, "fragment", "left").select(
        "id", "source", "chars", "bytes", "mark", "state", "fragment",
        F.col("inside").isNotNull().alias("known"),
        "reply",
        F.col("mark").rlike(_ELLIPSIS).alias("dots"),
    )
    judged = judged.withColumn(
        "unfinished",
        (F.col("state") == "broken") | ((F.col("mark") != "") & ~F.col("dots")) | ((F.col("mark") == "") & ~F.col("known") & ~F.col("reply")),
    )
    spikes = length_spikes(judged)
    limits = spikes.groupBy("source").agg(
        F.collect_set(F.when(F.col("unit") == "chars", F.col("spike"))).alias("char_spikes"),
        F.collect_set(F.when(F.col("unit") == "bytes", F.col("spike"))).alias("byte_spikes"),
    )
    near = judged.alias("j").join(limits.alias("l"), F.col("j.source").eqNullSafe(F.col("l.source")), "left").select(
        "j.*", *[F.coalesce(F.col(f"l.{c}"), F.array().cast("array<int>")).alias(c) for c in ("char_spikes", "byte_spikes")]
    )

    def hit(length: str, spikes: str) -> Column:
        return F.array_min(F.filter(spikes, lambda s: (F.col(length) <= s + 2) & (F.col(length) >= s - BACK_OFF)))

    by_chars = hit("chars", "char_spikes")
    near = near.withColumn("limit_length", F.coalesce(by_chars, hit("bytes", "byte_spikes"))).withColumn(
        "limit_unit", F.when(by_chars.isNotNull(), "chars").when(F.col("limit_length").isNotNull(), "bytes")
    )
    # a closing phrase of authors also ends texts that are nowhere near a limit
    elsewhere = near.filter(F.col("dots") & F.col("limit_length").isNull()).groupBy("fragment").agg(F.count(F.lit(1)).alias("elsewhere"))
    near = near.join(elsewhere, "fragment", "left")
    at_limit = F.col("limit_length").isNotNull()
    plain = F.col("fragment").rlike(r"^[^0§¤]*$") & (F.length("fragment") <= 60)
    some_limit = (F.size("char_spikes") > 0) | (F.size("byte_spikes") > 0)
    author = F.col("dots") & (
        F.col("known") | (F.coalesce("elsewhere", F.lit(0)) >= 2) | (~at_limit & (some_limit | plain))
    )
    cut = F.col("unfinished") | (F.col("dots") & ~author)
    found = near.filter(cut & ~((F.col("state") == "open") & author)).select(
        "id", "source", F.when(F.col("limit_length").isNull(), "transfer").otherwise("limit").alias("reason"), "limit_length", "limit_unit"
    )
    return found, spikes


def truncation_rates(docs: DataFrame, found: DataFrame, source: str) -> DataFrame:
    """(source, documents, truncated, at_limit, in_transfer, share) for every source, null included."""
    total = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("documents"))
    cut = found.groupBy(F.col("source").alias("s")).agg(
        F.count(F.lit(1)).alias("truncated"), F.count_if(F.col("reason") == "limit").alias("at_limit")
    )
    joined = total.join(cut, F.col("source").eqNullSafe(F.col("s")), "left")
    n, limit = F.coalesce("truncated", F.lit(0)), F.coalesce("at_limit", F.lit(0))
    return joined.select(
        "source", "documents", n.alias("truncated"), limit.alias("at_limit"), (n - limit).alias("in_transfer"),
        (n / F.col("documents")).alias("share"),
    )
