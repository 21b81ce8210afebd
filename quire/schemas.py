"""Declared schemas of the library relations."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {
    "long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampNTZType(), "variant": T.VariantType(),
    "strings": T.ArrayType(T.StringType()), "ints": T.ArrayType(T.IntegerType()), "longs": T.ArrayType(T.LongType()),
    "floats": T.ArrayType(T.FloatType()), "map": T.MapType(T.StringType(), T.StringType()),
    "findings": T.ArrayType(T.StructType([T.StructField("finding", T.StringType()), T.StructField("quote", T.StringType())])),
}


def _schema(text: str) -> T.StructType:
    fields = [part.split() for part in text.replace("\n", " ").split(",")]
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in fields])


LIBRARY: dict[str, T.StructType] = {name: _schema(text) for name, text in {
    "papers": """id long, title string, abstract string, year int, journal string, volume string, issue string, pages string,
        publisher string, doi string, arxiv_id string, pubmed_id string, zotero_key string, citation_key string, url string,
        citation_count int, read_status string, rating int, file_path string, file_hash string, word_count int,
        validation_status string, validation_source string, validation_confidence double, enrichment_status string,
        date_added timestamp, date_modified timestamp""",
    "authors": "id long, name string, orcid string, email string, affiliation string",
    "paper_authors": "paper_id long, author_id long, position int",
    "tags": "id long, name string, category string, color string",
    "paper_tags": "paper_id long, tag_id long",
    "collections": "id long, name string, description string, parent_id long",
    "paper_collections": "paper_id long, collection_id long",
    "notes": "id long, paper_id long, content string, note_type string, page_number int, position string, created_at timestamp",
    "paper_contents": """paper_id long, extraction_depth string, one_sentence_summary string, deep_one_sentence_summary string,
        paper_type string, deep_paper_type string, topics strings, deep_topics strings, key_findings findings,
        methodology_summary string, structured_data variant, verification variant, verification_score double,
        quick_date timestamp, deep_date timestamp, extractor_model string, schema_version string""",
    "project_relevances": "paper_id long, project string, level string, decision string",
    "paper_chunks": "paper_id long, chunk_order int, content string, word_count int, char_count int",
    "paper_tables": "paper_id long, table_order int, caption string, markdown string",
    "paper_figures": "paper_id long, figure_order int, figure_type string, figure_number string, caption string",
    "paper_references": """id long, paper_id long, reference_order int, raw_text string, parsed_title string, parsed_authors string,
        parsed_year int, parsed_journal string, parsed_doi string, parsed_arxiv_id string, match_status string,
        matched_paper_id long, parse_confidence double""",
    "paper_citations": "citing_paper_id long, cited_paper_id long, source string",
    "claim_citations": """id long, paper_id long, claim_text string, citation_numbers ints, section string, chunk_index int,
        claim_type string, reference_ids longs, matched_paper_ids longs, match_statuses strings, importance string""",
    "extraction_metadata": """paper_id long, chunking_status string, chunk_count int, chunking_queued_at timestamp, chunking_error string,
        needs_reextraction boolean""",
    "vectors": "id string, paper_id long, document string, embedding floats",
    "chunk_vectors": "chunk_id string, paper_id long, chunk_index int, section string, text string, embedding floats",
}.items()}
