"""Types of the records that move through the engine."""

from pyspark.sql import types as T


def _fields(text: str) -> list[T.StructField]:
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType()}
    return [T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in text.split())]


#: What a parser yields; extra holds what a format has besides.
ITEM = T.StructType(_fields("url:s type:s title:s external_id:s lang:s published_at:s updated_at:s summary:s starts_at:s ends_at:s tz:s city:s country:s instructor:s online:i") + [T.StructField("extra", T.MapType(T.StringType(), T.StringType()))])
#: A captured payload: what a connector returns, or what the raw store holds.
PAYLOAD = T.StructType(_fields("source_id:s endpoint:s fetched_at:s http_status:i latency_ms:i content_hash:s etag:s last_modified:s error:s") + [T.StructField("body", T.BinaryType())])
#: Rows of the fetch log; changed is null (first), 0 (same) or 1 (another).
FETCH = T.StructType(_fields("id:l source_id:s fetched_at:s endpoint:s http_status:i latency_ms:i content_hash:s etag:s last_modified:s raw_path:s changed:i error:s"))
ITEMS = T.StructType(_fields("id:l source_id:s url:s external_id:s type:s title:s summary:s title_pt:s summary_pt:s lang:s published_at:s updated_at:s discovered_at:s content_hash:s"))
EVENT = T.StructType(_fields("item_id:l starts_at:s ends_at:s tz:s city:s country:s online:i instructor:s lineage:s org_id:s region:s"))
WP_POSTS = T.ArrayType(T.StructType([*_fields("id:l link:s date_gmt:s modified_gmt:s"), T.StructField("title", T.StructType(_fields("rendered:s"))), T.StructField("excerpt", T.StructType(_fields("rendered:s")))]))
NEWS_API = T.StructType([T.StructField("data", T.ArrayType(T.StructType(_fields("id:s news_date:s kind:s kind_str:s link_type:s news_link:s news_title:s"))))])
AGENDA_API = T.StructType([T.StructField("data", T.ArrayType(T.StructType(_fields("id:s calendar_from_to:s calendar_title:s calendar_topics:s calendar_place:s kind:s kind_str:s"))))])
