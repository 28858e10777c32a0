"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from timelode.llm import align, exact, langid, licenses, lines, mixing, nndescent, packing, pii, runs, simhash, urls, warc

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_simhash": simhash.op2_simhash,
    "op3_mixing": mixing.op3_mixing,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_embedding_dedup": nndescent.op5_embedding_dedup,
    "op6_langid": langid.op6_langid,
    "op7_exact_dedup": exact.op7_exact_dedup,
    "op8_packing": packing.op8_packing,
    "op9_licenses": licenses.op9_licenses,
    "op10_warc": warc.op10_warc,
    "op11_runs": runs.op11_runs,
    "op12_urls": urls.op12_urls,
    "op13_align": align.op13_align,
}

ORACLES = {
    "op4_line_dedup": lines.OP4_SQL,
    "op7_exact_dedup": exact.OP7_SQL,
    "op10_warc": warc.OP10_SQL,
}
