"""The queries of the training-data operators, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from grafold.llm.additive_ann import op7_additive_ann
from grafold.llm.chat_format import OP5_SQL, op5_chat_format
from grafold.llm.decontaminate import op3_decontaminate
from grafold.llm.jaccard_join import OP1_SQL, op1_jaccard_join
from grafold.llm.language_id import op10_language_id
from grafold.llm.line_dedup import OP2_SQL, op2_line_dedup
from grafold.llm.passage_dedup import op8_passage_dedup
from grafold.llm.piece_codec import op6_piece_codec
from grafold.llm.pseudonyms import op4_pseudonyms
from grafold.llm.token_counts import op9_token_counts


def pipeline(spark, sf_dir: str):
    """All rows of the corpus pipeline, which stands at the top of the repository."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_line_dedup": op2_line_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_pseudonyms": op4_pseudonyms,
    "op5_chat_format": op5_chat_format,
    "op6_piece_codec": op6_piece_codec,
    "op7_additive_ann": op7_additive_ann,
    "op8_passage_dedup": op8_passage_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_language_id": op10_language_id,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {"op1_jaccard_join": OP1_SQL, "op2_line_dedup": OP2_SQL, "op5_chat_format": OP5_SQL}
