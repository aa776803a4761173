"""Spark types of the document model, as DDL, and their Arrow forms."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType

LOCATOR = (
    "struct<family:string,page:int,bbox:array<double>,paragraph_index:int,table_index:int,section:int,relationship_id:string,"
    "target_partname:string,line:int,section_path:string,cell_index:int,cell_type:string,extra:map<string,string>>"
)
ELEMENT = f"struct<ord:int,element_id:string,type:string,content:string,resource_path:string,parent_id:string,source_locator:{LOCATOR},confidence:double,metadata:string>"
SPAN = "struct<element_id:string,start:int,end:int>"
CHUNK = f"struct<chunk_id:string,text:string,source_element_ids:array<string>,metadata:struct<strategy:string,max_chars:int,char_count:int,split_boundary_after:string>,source_spans:array<{SPAN}>>"
RELATION = "struct<type:string,from_id:string,to_id:string,metadata:string>"
WARNING = "struct<code:string,reason:string,details:string>"
ERROR = "struct<code:string,message:string,details:string>"
PARSED = f"struct<elements:array<{ELEMENT}>,warnings:array<{WARNING}>,error:{ERROR},metadata:string>"

ELEMENT_TYPES = ("heading", "paragraph", "list_item", "table", "image", "caption", "header", "footer")
FAMILIES = {"markdown": "line_address", "html": "line_address", "text": "line_address", "docx": "structural_index", "pdf": "page_geometry", "ipynb": "container_line"}
SCHEMA_VERSIONS = ("0.1.0", "0.2.0", "0.3.0", "0.4.0", "0.5.0", "0.6.0")


def arrow(ddl: str) -> pa.DataType:
    """The Arrow type of a DDL type."""
    kind: DataType = DataType.fromDDL(ddl)
    return to_arrow_type(kind)


def fields(schema: StructType, names: list[str]) -> str:
    """DDL of some columns of a schema."""
    return ", ".join(f"`{c}` {schema[c].dataType.simpleString()}" for c in names)
