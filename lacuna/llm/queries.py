"""The registered queries op1 to op13: thin views of the operators over whole tables."""

from __future__ import annotations

from lacuna import ship


def _table(spark, sf_dir: str, name: str):
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(spark) -> str:
    """The vocabulary file; another place can be set as ``lacuna.tokenizer``."""
    import public_tokenizers

    return spark.conf.get("lacuna.tokenizer", public_tokenizers.path("word_bpe_49k.json"))


def op1_media_jpeg(spark, sf_dir):
    from lacuna.llm.media_jpeg import media_columns

    return media_columns(_table(spark, sf_dir, "documents"), keep_media=False)


def op2_ngram_jaccard(spark, sf_dir):
    from lacuna.llm.ngram_join import similar_components

    return similar_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_zstd_quality(spark, sf_dir):
    from lacuna.llm.quality_zstd import score

    return score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op4_kneser_ney(spark, sf_dir):
    from lacuna.llm.kn_lm import score

    return score(_table(spark, sf_dir, "documents"), order=3)


def op5_harmonic_packing(spark, sf_dir):
    from lacuna.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer_file(spark), keep_ids=False)


def op6_url_rules(spark, sf_dir):
    from lacuna.llm.url_rules import judge

    return judge(_table(spark, sf_dir, "pages"))


def op7_fm_dedup(spark, sf_dir):
    from lacuna.llm.fm_dedup import strip_repeats

    return strip_repeats(_table(spark, sf_dir, "documents"))


def op8_simhash_decontamination(spark, sf_dir):
    from lacuna.llm.decontam import passages

    return passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_license_scan(spark, sf_dir):
    from lacuna.llm.license_scan import scan

    return scan(_table(spark, sf_dir, "documents"), notices=False)


def op10_toxic_segments(spark, sf_dir):
    from lacuna.llm.toxic_segments import score

    return score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), passages=False)


def op11_tsqr_whitening(spark, sf_dir):
    from lacuna.llm.whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark, sf_dir):
    from lacuna.llm.conversation_repair import repair

    return repair(_table(spark, sf_dir, "conversations"))


def piece_model_file(spark) -> str:
    """The piece model; another place can be set as ``lacuna.piece_model``."""
    import public_tokenizers

    return spark.conf.get("lacuna.piece_model", public_tokenizers.path("piece_bpe_32k.model"))


def op13_piece_encoding(spark, sf_dir):
    from lacuna.llm.piece_encoding import digests, encode, read_model

    return digests(encode(_table(spark, sf_dir, "documents"), read_model(piece_model_file(spark))))


QUERIES = {
    f.__name__: f
    for f in (
        op1_media_jpeg,
        op2_ngram_jaccard,
        op3_zstd_quality,
        op4_kneser_ney,
        op5_harmonic_packing,
        op6_url_rules,
        op7_fm_dedup,
        op8_simhash_decontamination,
        op9_license_scan,
        op10_toxic_segments,
        op11_tsqr_whitening,
        op12_conversation_repair,
        op13_piece_encoding,
    )
}


def _oracles() -> dict[str, str]:
    from lacuna.llm import license_scan, url_rules

    return {"op6_url_rules": url_rules.oracle(), "op9_license_scan": license_scan.oracle()}


ORACLES = _oracles()
