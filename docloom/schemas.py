"""Schemas and fixed values shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values
CANONICAL_SCHEMA_VERSION = 1
NORMALIZER_VERSION = "mineru-v2"
PARSER_VERSION = "mineru-v4-vlm"
PARSER_BACKEND = "cloud_mineru"
PARSER_NAME = "Cloud MinerU"
PROMPT_VERSION = "academic-blocks-v1"
TARGET_LOCALE = "zh-CN"
TRANSLATION_MODE = "academic"
DEFAULT_CONTEXT_WINDOW = 32_768
MAX_REQUEST_BYTES = 2 * 1024 * 1024
MAX_RESPONSE_BYTES = 2 * 1024 * 1024

NOISE_TYPES = ["page_number", "footer", "aside_text"]
KNOWN_TYPES = ["text", "ref_text", "equation", "table", "image", "chart", "page_footnote"]
TRANSLATABLE_KINDS = ["heading", "paragraph", "list", "table", "caption"]
BLOCK_KINDS = ["heading", "paragraph", "list", "equation", "table", "figure", "caption"]
CHAPTER_ROLES = ["front_matter", "body", "references", "appendix"]
FILE_STATES = ["available", "missing", "changed", "unreadable"]
JOB_STATES = ["queued", "running", "succeeded", "failed", "cancelled", "interrupted"]
TRANSLATION_STATES = ["queued", "translating", "ready", "failed", "cancelled"]

LEAF_ATOM = "struct<type:string,value:string,id:string,latex:string,display:boolean,label:string>"
CELL = f"struct<row:int,column:int,rowSpan:int,columnSpan:int,content:array<{LEAF_ATOM}>>"
TABLE_ROWS = f"array<array<{CELL}>>"
ATOM = (
    "struct<type:string,value:string,id:string,latex:string,display:boolean,label:string,"
    f"assetId:string,alt:string,rows:{TABLE_ROWS}>"
)
ATOMS = f"array<{ATOM}>"
CONTENT = f"struct<plainText:string,atoms:{ATOMS}>"
BOX = (
    "struct<page:int,x:double,y:double,width:double,height:double,coordinateSpace:string>"
)

RAW_BLOCK = (
    "struct<type:string,text:string,text_level:int,bbox:array<double>,page_idx:int,"
    "img_path:string,image_caption:array<string>,image_footnote:array<string>,"
    "chart_caption:array<string>,chart_footnote:array<string>,table_caption:array<string>,"
    "table_footnote:array<string>,table_body:string>"
)
LAYOUT = "struct<pdf_info:array<struct<page_idx:int,page_size:array<double>>>>"
BLOCK_VALUE = (
    "struct<id:string,orderIndex:int,kind:string,pageStart:int,pageEnd:int,"
    f"boundingBoxes:array<{BOX}>,content:{CONTENT},sourceDigest:string>"
)
CHAPTER_VALUE = (
    "struct<id:string,orderIndex:int,depth:int,role:string,sourceTitle:string,pageStart:int,"
    f"pageEnd:int,blocks:array<{BLOCK_VALUE}>>"
)
ASSET_VALUE = "struct<id:string,mimeType:string,relativePath:string,sha256:string,sizeBytes:long>"
DOCUMENT_VALUE = (
    "struct<schemaVersion:int,artifactId:string,documentId:string,sourceSha256:string,"
    "parser:struct<name:string,version:string,backend:string>,normalizerVersion:string,"
    f"pageCount:int,title:string,chapters:array<{CHAPTER_VALUE}>,assets:array<{ASSET_VALUE}>>"
)

# the same two types as objects, for Arrow functions declared before a session exists
LEAF_TYPE = T.StructType([
    T.StructField(n, T.BooleanType() if n == "display" else T.StringType())
    for n in ("type", "value", "id", "latex", "display", "label")
])
CELL_TYPE = T.StructType([
    *[T.StructField(n, T.IntegerType()) for n in ("row", "column", "rowSpan", "columnSpan")],
    T.StructField("content", T.ArrayType(LEAF_TYPE)),
])
TABLE_TYPE = T.ArrayType(T.ArrayType(CELL_TYPE))
ATOM_TYPE = T.StructType([
    *LEAF_TYPE.fields, T.StructField("assetId", T.StringType()), T.StructField("alt", T.StringType()),
    T.StructField("rows", TABLE_TYPE),
])
