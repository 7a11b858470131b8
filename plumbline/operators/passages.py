"""Where given passages occur word for word in a table of documents."""
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a passage that are looked for first, from its middle; what they find is compared with the whole passage.
ANCHOR = 24


def _anchors(passages: list[tuple[str, str]]):
    """Automaton over the anchors; each leads to the passages it stands for and its place in them."""
    import ahocorasick

    by_anchor: dict[str, list[tuple[str, str, int]]] = {}
    for qid, text in passages:
        at = max(0, (len(text) - ANCHOR) // 2)
        by_anchor.setdefault(text[at:at + ANCHOR], []).append((qid, text, at))
    automaton = ahocorasick.Automaton()
    for anchor, own in by_anchor.items():
        automaton.add_word(anchor, (len(anchor), own))
    automaton.make_automaton()
    return automaton


def verbatim_places(items: DataFrame, docs: DataFrame, block_bytes: int = 8 << 20) -> DataFrame:
    """``qid, doc_id, section_id`` of the documents whose text contains the passage ``query`` of an item.

    Each text is read once for all passages, long and short alike, and only found pairs leave its row: no word of the corpus is
    shuffled.  Passages are broadcast, about ``block_bytes`` of them at a time; more are searched in blocks one after the
    other.  Empty passages and null texts are found nowhere.
    """
    items = items.where("query <> ''").select("qid", "query").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("query") + 200), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // block_bytes))
    docs = docs.where(F.col("text").isNotNull()).select("doc_id", "section_id", "text")
    schema = f"qid {items.schema['qid'].dataType.simpleString()}, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields[:2])

    def search(block: int) -> DataFrame:
        rows = items.where(F.pmod(F.xxhash64("qid", "query"), F.lit(n_blocks)) == block).collect()  # about block_bytes
        shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in rows])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _anchors(shared.value) if shared.value else None
            for batch in batches:
                qids, places = [], []
                for i, value in enumerate(batch.column("text") if automaton else ()):
                    text, seen = value.as_py(), set()
                    for end, (length, own) in automaton.iter(text):
                        for qid, passage, at in own:
                            if (qid, passage) not in seen and text.startswith(passage, max(0, end - length + 1 - at)):
                                seen.add((qid, passage))
                                qids.append(qid)
                                places.append(i)
                at = pa.array(places, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(qids, items_type), batch.column("doc_id").take(at), batch.column("section_id").take(at)],
                                                 ["qid", "doc_id", "section_id"])

        return docs.mapInArrow(run, schema)

    items_type = pa.string() if items.schema["qid"].dataType.simpleString() == "string" else pa.int64()
    found = search(0)
    for block in range(1, n_blocks):
        found = found.unionByName(search(block))
    return found.distinct()
