"""Where results go: tables, an alert outbox, and a static page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import script_safe_json
from ..operators import report


def write_outbox(messages: DataFrame, path: str, now: str) -> None:
    """Alerts of a run as a table of their own; a repeated run overwrites itself. Sending is somebody else's work."""
    messages.select("kind", "id", "domain", "message").write.mode("overwrite").parquet(f"{path.rstrip('/')}/{now.replace(':', '')}")


PAGE = """<!doctype html><meta charset="utf-8"><title>Catalogue</title><h1>Catalogue</h1><p id="n"></p><input id="q" placeholder="filter"><table id="t"></table>
<script id="data" type="application/json">{data}</script>
<script>
const rows = JSON.parse(document.getElementById("data").textContent).products, t = document.getElementById("t"), q = document.getElementById("q");
const esc = s => String(s ?? "").replace(/[&<>"]/g, c => "&#" + c.charCodeAt(0) + ";");
const show = () => {{
  const hits = rows.filter(r => JSON.stringify(r).toLowerCase().includes(q.value.trim().toLowerCase()));
  document.getElementById("n").textContent = hits.length + " products";
  t.innerHTML = hits.slice(0, {size}).map(r => `<tr><td>${{esc(r.domain)}}<td><a href="${{esc(r.url)}}">${{esc(r.name)}}</a><td>${{esc(r.price)}}<td>${{r.available === true ? "in" : r.available === false ? "out" : "?"}}`).join("");
}};
q.oninput = show; show();
</script>
"""


def dashboard_page(rows: DataFrame, most: int = 10_000) -> str:
    """A static page over the first ``most`` rows of the default order: the bound is what a browser can hold."""
    first = rows.orderBy(*report.default_order()).limit(most).select(script_safe_json(F.to_json(F.struct(*rows.columns))).alias("j"))
    return PAGE.format(data='{"products":[' + ",".join(r.j for r in first.collect()) + "]}", size=report.PAGE_SIZE)
