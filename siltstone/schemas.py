"""Schemas of the engine's tables."""

from __future__ import annotations

BLOCK = "struct<kind:string,text:string,heading_path:array<string>,source_start_line:int,source_end_line:int,metadata:map<string,string>>"
LINK = "struct<kind:string,label:string,target:string,source_line:int>"
DOCUMENT = (
    "logical_path string, media_type string, parser_id string, title string, language string, text string, "
    f"blocks array<{BLOCK}>, links array<{LINK}>, tags array<string>, frontmatter map<string,string>, "
    "normalized_content_hash string, structure_hash string, error string"
)
CHUNK = (
    "ordinal int, content_text string, content_hash string, block_kind string, token_estimate int, heading_path array<string>, "
    "source_start_line int, source_end_line int, anchor_key string"
)
OBSERVATION = (
    "observation_id string, relative_path string, normalized_path_key string, file_identity string, content_hash string, "
    "state string, missing_since timestamp, version int"
)
INVENTORY = "relative_path string, normalized_path_key string, file_identity string, content_hash string"
