"""Row types of products, runs, state and pages."""

from __future__ import annotations

STRINGS = "array<string>"
STRING_MAP = "map<string,string>"

#: A product row; ``seq`` is its place in the input, which first-wins and last-wins rules go by.
PRODUCT = (
    "id string, domain string, url string, name string, price string, currency string, description string, specs map<string,string>, available boolean, "
    "variant_of string, location string, locations array<string>, location_links map<string,string>, billing_cycles array<string>, cycle_prices map<string,string>, is_special boolean, seq bigint"
)
META = "struct<may_be_incomplete:boolean,deadline_exceeded:boolean,discovery_stop_reason:string,discovery_fetch_errors:int>"
#: One run of one target; ``seq`` orders runs.
RUN = f"domain string, ok boolean, error string, duration_ms bigint, meta {META}, seq bigint"
#: What the state holds of a product.
STATE_PRODUCT = (
    "id string, domain string, url string, name string, price string, currency string, description string, specs map<string,string>, variant_of string, location string, locations array<string>, "
    "location_links map<string,string>, billing_cycles array<string>, cycle_prices map<string,string>, is_special boolean, available boolean, first_seen string, last_seen string, last_change string, "
    "last_notified_new string, last_notified_restock string, last_notified_new_location string"
)
STATE_DOMAIN = "domain string, last_status string, last_ok string, last_error string, last_duration_ms bigint"
#: A fetched page; ``seq`` is its place among the pages of the run, below 2 ** 36.
PAGE = "url string, status_code int, ok boolean, text string, error string, elapsed_ms bigint, seq bigint"
#: A captured JSON storefront.
STORE_JSON = (
    "struct<id:bigint,area_name:string,nodes:array<struct<id:bigint,node_name:string,group_name:string,plans:array<struct<id:bigint,plan_name:string,tag:string,cpu:double,memory:double,disk:double,"
    "stock:bigint,flow:double,bandwidth:double,ipv4_num:double,ipv6_num:double,price_datas:array<struct<price:double,cycle:bigint>>>>>>>"
)
