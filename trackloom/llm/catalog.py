"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from . import automaton, centroids, chat, contam, exact, lengths, lines, merkle, pieces, simhash, substrings, toxic, urls


def queries() -> dict[str, Callable]:
    found = [
        exact.op1_exact_dedup,
        chat.op2_chat_format,
        contam.op3_decontaminate,
        lines.op4_line_dedup,
        substrings.op5_suffix_dedup,
        simhash.op6_simhash,
        pieces.op7_sentencepiece,
        lengths.op8_token_counts,
        toxic.op9_toxicity,
        urls.op10_url_filter,
        merkle.op11_merkle,
        centroids.op12_centroids,
        automaton.op13_bpe,
    ]
    import corpus_pipeline

    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact.OP1_SQL,
        "op2_chat_format": chat.OP2_SQL,
        "op3_decontaminate": contam.OP3_SQL,
        "op4_line_dedup": lines.OP4_SQL,
        "op5_suffix_dedup": substrings.OP5_SQL,
        "op10_url_filter": urls.OP10_SQL,
        "op11_merkle": merkle.OP11_SQL,
        "op12_centroids": centroids.OP12_SQL,
    }
