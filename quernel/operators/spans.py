"""Token spans of a prompt's parts, and the gate that checks them. All within the row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions import text

# Why a sample is not valid.
NOTES = {
    "passage": "passage substring not found in rendered prompt",
    "query": "query substring not found in rendered prompt",
    "injection": "injection substring not found in rendered prompt",
    "tokens": "token span mapping failed",
    "length": "query range truncated beyond max_seq_len",
}


def word_offsets(prompt: Column) -> Column:
    """(s, e) of the pieces between spaces, in order, as a column that other tokenizers' offsets may stand in for."""
    pieces = F.split(prompt, " ")
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))
    step = lambda a, w: F.struct((a["at"] + F.length(w) + 1).alias("at"), F.array_append(a["out"], F.struct(a["at"].alias("s"), (a["at"] + F.length(w)).alias("e"))).alias("out"))
    return F.aggregate(pieces, state, step, lambda a: a["out"])


def span_tokens(offsets: Column, start: Column, end: Column) -> Column:
    """(first, last + 1) of the tokens that overlap characters start to end; null if none does."""
    at = F.filter(F.transform(offsets, lambda t, i: F.when((t["e"] > start) & (t["s"] < end), i)), lambda i: i.isNotNull())
    return F.when(F.size(at) > 0, F.struct(F.array_min(at).alias("s"), (F.array_max(at) + 1).alias("e")))


def word_count(prompt: Column) -> Column:
    """How many pieces between spaces there are."""
    return F.length(prompt) - F.length(F.replace(prompt, F.lit(" "))) + 1


def word_span(prompt: Column, start: Column, end: Column) -> Column:
    """span_tokens of the pieces between spaces: their numbers are the spaces before them, so no offsets are built."""
    s = word_count(F.left(prompt, start + 1)) - 1 + (start >= F.length(prompt)).cast("int")
    e = word_count(F.left(prompt, F.greatest(end - 1, F.lit(0))))
    return F.when((s < e) & (end > 0), F.struct(s.alias("s"), e.alias("e")))


def word_text(prompt: Column, span: Column) -> Column:
    """The text that a range of the pieces between spaces covers."""
    upto = F.call_function("substring_index", prompt, F.lit(" "), span["e"])
    skipped = F.when(span["s"] > 0, F.length(F.call_function("substring_index", prompt, F.lit(" "), span["s"])) + 1).otherwise(0)
    return F.substring(upto, skipped + 1, F.length(upto))


def encode(df: DataFrame, max_seq_len: int = 1024, tail: int = 48, template: str = text.PLAIN_PROMPT, offsets: str | None = None) -> DataFrame:
    """Render each sample (passage, query, injection, injection_offset) and locate its parts.

    Tokens are the pieces between spaces, or those of the column offsets. Adds prompt, n_tokens, p_tok, q_tok, i_tok (for clean rows the passage's last `tail` tokens), valid and note."""
    out = df.withColumn("prompt", text.render(template, query=F.col("query"), passage=F.col("passage")) if "{query}" not in template else F.concat(*_parts(template)))
    out = out.withColumn("_p", text.find(F.col("prompt"), F.col("passage")))
    out = out.withColumn("_q", text.find(F.col("prompt"), F.col("query"), F.when(F.col("_p") >= 0, F.col("_p") + F.length("passage")).otherwise(F.lit(0))))
    injected = F.coalesce(F.length("injection") > 0, F.lit(False))
    off = F.col("injection_offset")
    known = (F.col("_p") >= 0) & off.isNotNull() & off["start"].isNotNull()
    searched = text.find(F.col("prompt"), F.coalesce("injection", F.lit("")))
    out = out.withColumn("_i", F.when(~injected, F.lit(-1)).when(known, F.col("_p") + off["start"]).otherwise(searched))
    out = out.withColumn("_ie", F.col("_i") + F.when(injected & known, off["end"] - off["start"]).otherwise(F.coalesce(F.length("injection"), F.lit(0))))
    out = out.withColumn("n_tokens", F.size(offsets) if offsets else word_count(F.col("prompt")))
    tok = lambda c, end: F.when(F.col(c) >= 0, span_tokens(F.col(offsets), F.col(c), end) if offsets else word_span(F.col("prompt"), F.col(c), end))
    out = out.withColumns({"p_tok": tok("_p", F.col("_p") + F.length("passage")), "q_tok": tok("_q", F.col("_q") + F.length("query")), "_t": tok("_i", F.col("_ie"))})
    note = (
        F.when(F.col("_p") < 0, NOTES["passage"])
        .when(F.col("_q") < 0, NOTES["query"])
        .when(injected & (F.col("_i") < 0), NOTES["injection"])
        .when(F.col("p_tok").isNull() | F.col("q_tok").isNull(), NOTES["tokens"])
        .when((F.col("n_tokens") > max_seq_len) & (F.col("q_tok.e") > max_seq_len), NOTES["length"])
        .otherwise("")
    )
    tail_span = F.struct(F.greatest(F.col("p_tok.s"), F.col("p_tok.e") - tail).alias("s"), F.col("p_tok.e").alias("e"))
    out = out.withColumns({"note": note, "i_tok": F.coalesce(F.col("_t"), F.when(F.col("p_tok").isNotNull(), tail_span)), "n_tokens": F.least("n_tokens", F.lit(max_seq_len))})
    return out.withColumn("valid", F.col("note") == "").drop("_p", "_q", "_i", "_ie", "_t")


def _parts(template: str) -> list[Column]:
    import re

    return [F.col(p[1:-1]) if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w+\})", template) if p]


def decoded(prompt: Column, offsets: Column, span: Column) -> Column:
    """The text that a token range covers."""
    return text.between(prompt, F.element_at(offsets, span["s"] + 1)["s"], F.element_at(offsets, span["e"])["e"])


def gate(encoded: DataFrame, head: int = 60, query_head: int = 40, share: float = 0.8, offsets: str | None = None) -> DataFrame:
    """Check that each range holds its text: ok_passage, ok_query, ok_injection and all_ok for every sample.

    snippets has the beginning and end, `head` characters each, of what each range covers: p, q and i, for reports."""
    norm = lambda c: F.lower(F.regexp_replace(c, text.SPACE, " "))
    covered = {k: decoded(F.col("prompt"), F.col(offsets), F.col(f"{k}_tok")) if offsets else word_text(F.col("prompt"), F.col(f"{k}_tok")) for k in "pqi"}
    ends = lambda c: F.struct(F.left(c, F.lit(head)).alias("head"), F.right(c, F.lit(head)).alias("tail"))
    out = encoded.withColumn("snippets", F.struct(*(ends(c).alias(k) for k, c in covered.items())))
    out = out.withColumns({f"_{k}": norm(c) for k, c in covered.items()} | {"_sp": norm(F.col("passage")), "_sq": norm(F.col("query"))})
    ok_p = F.contains("_p", F.substring("_sp", 1, head)) | F.contains(F.col("_p"), F.right("_sp", F.lit(head))) | (text.containment(F.col("_sp"), F.col("_p")) > share)
    ok_q = F.contains("_q", F.substring("_sq", 1, query_head)) | (text.containment(F.col("_sq"), F.col("_q")) > share)
    ok_i = F.when(F.coalesce(F.length("injection"), F.lit(0)) > 0, text.containment(norm(F.col("injection")), F.col("_i")) > share).otherwise(True)
    no = lambda c: F.coalesce(c, F.lit(False))
    out = out.withColumns({"ok_passage": no(ok_p), "ok_query": no(ok_q), "ok_injection": no(ok_i)})
    return out.withColumn("all_ok", F.col("valid") & F.col("ok_passage") & F.col("ok_query") & F.col("ok_injection")).drop("_p", "_q", "_i", "_sp", "_sq")


def gate_summary(gated: DataFrame) -> DataFrame:
    return gated.agg(F.count("*").alias("n_samples"), F.count_if("all_ok").alias("n_ok")).withColumn("passed", (F.col("n_ok") == F.col("n_samples")) & (F.col("n_samples") > 0))


def mass_reduce(attention: DataFrame, ranges: DataFrame) -> DataFrame:
    """Sum attention (sample_id, layer, head, qpos, kpos, a) from the query's rows to each part's columns.

    ranges: sample_id and p_tok, q_tok, i_tok. One pass: a range join by sample and a partial aggregate."""
    k = F.col("kpos")
    inside = lambda r: (k >= F.col(f"{r}.s")) & (k < F.col(f"{r}.e"))
    part = lambda r, name: F.sum(F.when(inside(r), F.col("a")).otherwise(0.0)).alias(name)
    asked = attention.join(ranges, "sample_id").where((F.col("qpos") >= F.col("q_tok.s")) & (F.col("qpos") < F.col("q_tok.e")))
    return asked.groupBy("sample_id", "layer", "head").agg(part("p_tok", "m_qp"), part("i_tok", "m_qi"), part("q_tok", "m_qq"))
