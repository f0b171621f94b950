"""Types of the records that flow between operators, as DDL strings."""

MEDIA = "struct<seq:int,url:string,kind:string,origin:string,width:int,path_hint:string>"
BLOB = "struct<source:string,score:double,data:string>"
SCRIPT = "struct<score:double,text:string>"
EVIDENCE = (
    f"struct<json_ld:array<string>,meta:map<string,string>,title:string,canonical_url:string,h1:string,"
    f"json_blobs:array<{BLOB}>,script_texts:array<{SCRIPT}>,visible_text:string,sightings:array<{MEDIA}>>"
)
SELECTION = "struct<name:string,value:string>"
OPTION = "struct<name:string,values:array<string>>"
VARIANT = f"struct<selections:array<{SELECTION}>,sku:string,price:double,available:boolean,image_urls:array<string>>"
PRICE = "struct<price:double,currency:string,compare_at_price:double>"
CATEGORY = "struct<name:string>"
PRODUCT = (
    f"name string, price {PRICE}, description string, key_features array<string>, image_urls array<string>, video_url string, "
    f"category {CATEGORY}, brand string, colors array<string>, options array<{OPTION}>, variants array<{VARIANT}>"
)
#: Ground truth: variants are a list of variants or {"count", "axes"}, so they are read as text.
TRUTH = PRODUCT.rsplit(", variants ", 1)[0] + ", variants string"
DRAFT_VARIANT = f"struct<selections:array<{SELECTION}>,sku:string,price:double,available:boolean,image_ids:array<int>>"
DRAFT = (
    f"struct<name:string,price:double,currency:string,compare_at_price:double,description:string,key_features:array<string>,image_ids:array<int>,"
    f"video_id:int,candidate_categories:array<string>,brand:string,colors:array<string>,options:array<{OPTION}>,variants:array<{DRAFT_VARIANT}>>"
)
