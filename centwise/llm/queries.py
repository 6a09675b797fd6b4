"""The queries of this package; the driver registers them only where the package imports."""

from __future__ import annotations

import corpus_pipeline
from centwise.llm.ann import op8_nearest
from centwise.llm.bpe import op10_byte_bpe
from centwise.llm.chat import op3_chat
from centwise.llm.decontaminate import op9_decontamination
from centwise.llm.html_text import op2_html_text
from centwise.llm.lines import op4_line_dedup
from centwise.llm.mixing import op13_mixing
from centwise.llm.negatives import op12_negatives
from centwise.llm.quality import op6_quality
from centwise.llm.sharding import op7_sharding
from centwise.llm.simhash import op1_simhash
from centwise.llm.structure import op11_structure
from centwise.llm.warc import op5_warc

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_html_text": op2_html_text,
    "op3_chat": op3_chat,
    "op4_line_dedup": op4_line_dedup,
    "op5_warc": op5_warc,
    "op6_quality": op6_quality,
    "op7_sharding": op7_sharding,
    "op8_nearest": op8_nearest,
    "op9_decontamination": op9_decontamination,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_structure": op11_structure,
    "op12_negatives": op12_negatives,
    "op13_mixing": op13_mixing,
    "pipeline": corpus_pipeline.run,
}
