"""Prompt texts and parsing of model replies, as column expressions over arrays of source structs."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import let, strip

DEFAULT_SYSTEM = (
    "Answer from the numbered sources only and cite each claim as [Source N]. Use Markdown headings and lists, "
    "show tabular data as a Markdown table, and embed a relevant image source as ![description](source_N).")
DEFAULT_IMAGE_REMINDER = (
    "Some sources are images. If one helps to answer, embed it inline as ![description](source_N), "
    "without code fences or backticks.")
DEFAULT_GUARD = (
    "Check whether every claim of the answer is supported by the sources. Reply with JSON only: "
    '{"verified": true or false, "score": 0.0 to 1.0, "claims": [{"claim": "...", "supported": true or false}]}')

# Layout of sources in prompts, cut lengths, and source references in answers.
PROMPT_CONTENT_CHARS = 1500
GUARD_ANSWER_CHARS, GUARD_SOURCE_CHARS, GUARD_SOURCES = 1000, 500, 5
UPLOAD_PREFIX = "/api/uploads/"
SOURCE_REFERENCE = r"(?i)(?:/api/uploads/)?source_([0-9]+)"
FENCED_IMAGE = r"(?i)```(?:markdown)?\s*(!?\[[^\n]*?\]\([^\n]*?\))\s*```"


def format_context(sources: Column) -> Column:
    """``[i][MODALITY|doc] content`` blocks, blank line between; ``doc`` is the first eight characters."""
    block = lambda s, i: F.concat(
        F.lit("["), (i + 1).cast("string"), F.lit("]["), F.upper(s["modality"]), F.lit("|"),
        F.substring(s["doc_id"], 1, 8), F.lit("] "), s["content"])
    return F.array_join(F.transform(sources, block), "\n\n")


def build_prompt(query: Column, sources: Column, system: str = DEFAULT_SYSTEM,
                 image_reminder: str = DEFAULT_IMAGE_REMINDER) -> Column:
    """System text, one block per source, question, and a reminder when any source is an image."""
    def block(s, i):
        url = F.concat(F.lit(f", Image URL: {UPLOAD_PREFIX}"), s["metadata"]["source"])
        is_linked_image = (s["modality"] == "image") & (F.coalesce(s["metadata"]["source"], F.lit("")) != "")
        label = F.concat(F.coalesce(s["modality"], F.lit("unknown")), F.when(is_linked_image, url).otherwise(""))
        return F.concat(F.lit("\n[Source "), (i + 1).cast("string"), F.lit(" ("), label, F.lit(")]:\n"),
                        F.substring(F.coalesce(s["content"], F.lit("")), 1, PROMPT_CONTENT_CHARS), F.lit("\n"))

    reminder = F.when(F.exists(sources, lambda s: s["modality"] == "image"),
                      F.lit(f"\n\n{image_reminder}")).otherwise("")
    return F.concat(F.lit(f"{system}\n\n--- Sources ---\n"), F.array_join(F.transform(sources, block), ""),
                    F.lit("\n\n--- Question ---\n"), query, reminder)


def build_guard_prompt(answer: Column, contents: Column, instructions: str = DEFAULT_GUARD) -> Column:
    """Instructions, the cut answer, and the first five cut sources, numbered."""
    numbered = F.transform(F.slice(contents, 1, GUARD_SOURCES), lambda s, i: F.concat(
        F.lit("[Source "), (i + 1).cast("string"), F.lit("]: "), F.substring(s, 1, GUARD_SOURCE_CHARS)))
    return F.concat(F.lit(f"{instructions}\n\nAnswer: "), F.substring(answer, 1, GUARD_ANSWER_CHARS),
                    F.lit("\n\nSources:\n"), F.array_join(numbered, "\n\n"))


CLAIMS = "array<struct<claim:string,supported:boolean>>"


def parse_guard(reply: Column, answer: Column, contents: Column) -> Column:
    """``struct<verified, score, claims>``.  No answer or no sources: (true, 1.0, []).  Unreadable reply:
    (true, 0.5, []).  Missing fields take true, 0.5 and []."""
    no_claims = F.array().cast(CLAIMS)

    def verdict(verified, score, claims):
        return F.struct(verified.alias("verified"), score.alias("score"), claims.alias("claims"))

    def parsed(body):
        doc = F.try_parse_json(body)
        raw_score = F.try_variant_get(doc, "$.score", "string")
        score = F.when(F.try_variant_get(doc, "$.score", "variant").isNull(), F.lit(0.5)).otherwise(
            F.coalesce(raw_score.try_cast("double"),
                       F.try_variant_get(doc, "$.score", "boolean").cast("double")))
        is_object = F.schema_of_variant(doc).startswith("OBJECT")
        readable = F.coalesce(is_object, F.lit(False)) & score.isNotNull()
        return F.when(readable, verdict(
            F.coalesce(F.try_variant_get(doc, "$.verified", "boolean"), F.lit(True)), score,
            F.coalesce(F.try_variant_get(doc, "$.claims", CLAIMS), no_claims),
        )).otherwise(verdict(F.lit(True), F.lit(0.5), no_claims))

    trimmed = strip(reply)
    fenced = F.regexp_replace(F.get(F.split(trimmed, "```"), F.lit(1)), "^json", "")
    body = F.when(trimmed.startswith("```"), fenced).otherwise(trimmed)
    nothing_to_check = (F.coalesce(answer, F.lit("")) == "") | (F.coalesce(F.size(contents), F.lit(0)) <= 0)
    return F.when(nothing_to_check, verdict(F.lit(True), F.lit(1.0), no_claims)).otherwise(let(body, parsed))


def resolve_source_refs(content: Column, sources: Column) -> Column:
    """Written-out ``\\n`` becomes a line end, fenced image tags are unwrapped, and ``source_N`` becomes the upload
    address of the N-th source; unknown references stay.  One pass, so replaced text is never matched again."""
    plain = F.regexp_replace(F.regexp_replace(content, r"\\n", "\n"), FENCED_IMAGE, "$1")

    def substitute(text):
        gaps = F.split(text, SOURCE_REFERENCE, -1)
        refs = F.regexp_extract_all(text, F.lit(SOURCE_REFERENCE), F.lit(0))
        numbers = F.regexp_extract_all(text, F.lit(SOURCE_REFERENCE), F.lit(1))
        urls = F.zip_with(refs, numbers, lambda ref, n: F.coalesce(
            F.concat(F.lit(UPLOAD_PREFIX), F.nullif(F.get(sources, n.try_cast("int") - 1)["metadata"]["source"],
                                                   F.lit(""))), ref))
        return F.array_join(F.zip_with(gaps, urls, lambda gap, url: F.concat(gap, F.coalesce(url, F.lit("")))), "")

    return let(plain, substitute)


def source_card(modality: Column, expert_id: Column, chunk_id: Column, content: Column, metadata: Column,
                max_chars: int = 1000) -> Column:
    return F.struct(chunk_id.alias("chunk_id"), F.coalesce(modality, expert_id).alias("modality"),
                    F.coalesce(expert_id, modality).alias("expert_id"),
                    F.substring(F.coalesce(content, F.lit("")), 1, max_chars).alias("content"),
                    metadata.alias("metadata"))


