"""Schemas of the engine's tables, as DDL strings."""

WORDS = "doc_id string, page int, pos int, level int, block int, par int, line int, word int, left int, top int, width int, height int, conf string, text string"
PAGES = "doc_id string, page int, text string, confidence double, dpi int, preprocessing_pipeline array<string>"
DOCUMENTS = "doc_id string, path string, text string, average_confidence double, text_source string, mtime timestamp"
ROSTER = "row_index int, raw_value string, mb string, revenue bigint, assets bigint, capital_loss bigint"
ATTEMPTS = "doc_id string, attempt int, dpi int, confidence double"

BOX = "struct<left:int,top:int,right:int,bottom:int>"
#: A year or row-code column: page, label, box and text of the header.
COLUMN = "struct<page:int,label:string,left:int,top:int,right:int,bottom:int,text:string>"
MESSAGE = "struct<code:string,message:string,context:map<string,string>>"

#: Result columns in the order of the roster, with their headers.
RESULTS = {"revenue": "Пословни приходи (000 РСД)", "assets": "Укупна актива (000 РСД)", "capital_loss": "Губитак изнад висине капитала (000 РСД)"}
