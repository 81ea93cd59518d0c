"""Words, tables and patterns that results depend on.

Their wording and order are part of the semantics; nothing here is logic. Some
are garbled on purpose: pages hold them so. Only characters that don't print are
written as escapes.
"""

# --- money -------------------------------------------------------------
AMOUNT = r"\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?|\d{1,6}(?:[.,]\d{1,2})?"
CURRENCY_TOKENS = [
    "HK$", "US$", "NT$", "$", "€", "£", "¥", "￥", "元",
    "USD", "EUR", "GBP", "HKD", "CNY", "RMB", "JPY", "TWD",
    "鈧?", "拢", "楼", "锟?", "鍏?",
]
CURRENCY_CODES = {
    "$": "USD", "US$": "USD",
    "€": "EUR", "鈧?": "EUR",
    "£": "GBP", "拢": "GBP",
    "¥": "CNY", "￥": "CNY", "元": "CNY", "楼": "CNY", "锟?": "CNY", "鍏?": "CNY", "RMB": "CNY",
    "HK$": "HKD",
    "NT$": "TWD",
}
PRICE_NUMBER = r"(\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d+(?:\.\d+)?)"
PREFERRED_CYCLES = ["Monthly", "Quarterly", "Yearly"]
DASHBOARD_CYCLES = ["Monthly", "Quarterly", "Semiannual", "Yearly", "Biennial", "Triennial", "One-Time"]
MESSAGE_CYCLES = ["Monthly", "Quarterly", "Semiannual", "Yearly", "Biennial", "Triennial", "Quadrennial", "Quinquennial", "One-Time"]
MESSAGE_SPECS = ["CPU", "RAM", "Disk", "Storage", "Transfer", "Traffic", "Bandwidth", "Port", "IPv4", "IPv6", "Location", "Data Center"]
MONTHS = {1: "Monthly", 3: "Quarterly", 6: "Semiannual", 12: "Yearly", 24: "Biennial", 36: "Triennial"}

# --- availability ------------------------------------------------------
OUT_WORDS = [
    "out of stock", "sold out", "unavailable", "no stock", "stockout", "out-of-stock", "sold-out", "not available", "unavailable for order",
    "已售罄", "售罄", "缺货", "無庫存", "无库存", "暂时缺货", "暫時缺貨",
    "不可用", "不可购买", "不可購買", "库存不足", "庫存不足", "缂鸿揣",
]
IN_WORDS_STRONG = ["in stock", "instock", "available now", "有库存", "有庫存", "库存充足", "庫存充足"]
IN_WORDS_WEAK = [
    "add to cart", "order now", "buy now", "加入购物车", "加入購物車", "立即购买", "立即購買",
    "立即订购", "立即訂購", "可购买", "可購買", "绔嬪嵆璁㈣喘", "绔嬪嵆璐\ue15d拱",
]
COUNT_THEN_WORD = r"(?iuU)(\d+)\s*(?:available|left|in\s*stock|库存|庫存|可用|鍙敤)\b"
WORD_THEN_COUNT = r"(?iuU)(?:stock|inventory|available|left|库存|庫存|可用|鍙敤)\s*[:：]?\s*(-?\d+)\b"

# --- billing cycles ----------------------------------------------------
CYCLE_LABELS = {
    "m": "Monthly", "month": "Monthly", "monthly": "Monthly",
    "q": "Quarterly", "quarter": "Quarterly", "quarterly": "Quarterly",
    "s": "Semiannual", "semi-annual": "Semiannual", "semiannually": "Semiannual", "semi-annually": "Semiannual",
    "a": "Yearly", "annual": "Yearly", "annually": "Yearly", "yearly": "Yearly",
    "b": "Biennial", "biennially": "Biennial",
    "t": "Triennial", "triennially": "Triennial",
    "quadrennially": "Quadrennial", "quinquennially": "Quinquennial",
    "onetime": "One-Time", "one time": "One-Time", "one-time": "One-Time",
}
CYCLE_CHARACTERS = [
    ("月", "Monthly"), ("姣忔湀", "Monthly"), ("季", "Quarterly"), ("半年", "Semiannual"), ("三年", "Triennial"),
    ("兩年", "Biennial"), ("两年", "Biennial"), ("二年", "Biennial"), ("年", "Yearly"), ("一次", "One-Time"),
]
CYCLE_TOKENS = (
    r"(?iuU)(monthly|quarterly|semi-annual(?:ly)?|semiannually|annually|yearly|biennially|triennially|quadrennially|quinquennially|one-?time|onetime"
    r"|月付|月繳|季付|季繳|半年|年付|年繳|一次性|一次|姣忔湀)"
)

# --- locations ---------------------------------------------------------
LOCATION_HINTS = [
    "location", "datacenter", "data center", "zone", "region", "node", "pop", "facility", "dc",
    "機房", "机房", "資料中心", "数据中心", "地区", "地區",
]
LOCATION_BLOCKS = [
    "os", "template", "hostname", "ssh", "password", "backup", "billing", "cycle", "period", "ipv4", "ipv6", "bandwidth", "traffic", "transfer", "license",
    "control panel", "kernel", "rescue",
]
VALUE_BLOCKS = ["", "none", "n/a", "no", "no thanks", "default", "please choose", "select", "--"]

# --- offers, names -----------------------------------------------------
SPECIAL_WORDS = [
    "special", "specials", "promo", "promotion", "deal", "flash sale", "black friday", "cyber monday", "limited offer",
    "特供", "專供", "专供", "限时", "限時",
]
TIER_NAMES = ["starter", "standard", "pro", "premium"]
NOISE_NAMES = [
    "make payment", "transfer domains", "buy a domain", "order hosting", "browse all", "cart is empty", "introduction", "service introduction", "about us",
    "product category", "site introduction", "pricing and plans", "pricing table", "产品介绍", "產品介紹", "站点介绍", "網站介紹",
    "pricing only", "proceed to cart",
]
NOISE_SHORT_NAMES = ["new", "item", "product"]
SUPPORT_URLS = ["/ticket", "/tickets", "submitticket", "support"]

# --- URLs --------------------------------------------------------------
TRACKING_KEYS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "fbclid", "systpl", "languagechange"]
PRODUCT_ID_KEYS = ["pid", "id", "product", "product_id", "planid"]
DROP_IF_PRODUCT_KEYS = ["gid", "fid", "cat_id", "step", "billingcycle", "cycle"]
NON_PRODUCT_FRAGMENTS = [
    "clientarea.php", "register", "login", "ticket", "tickets", "submitticket.php", "announcements", "knowledgebase", "downloads", "serverstatus", "contact", "about",
    "privacy", "terms", "tos", "protocol", "refund", "changelog", "status", "faq", "blog", "vps-hosting.php",
]
SECOND_LEVEL = ["co", "com", "net", "org", "gov", "edu"]
ENTRY_PATHS = ["/cart.php", "/index.php?rp=/store", "/store", "/cart", "/index.php?/cart/", "/products", "/billing/cart.php", "/billing/index.php?rp=/store", "/billing/store"]
CLIENT_ENTRY_PATHS = ["/clients/cart.php", "/clients/index.php?rp=/store", "/clients/store"]
WHMCS_ENTRIES = ["/cart.php", "/index.php?rp=/store", "/store"]
#: Parts of addresses that list nothing, parts of click handlers that lead to listings, and of listings that end in .php.
NO_LISTING_PARTS = ["a=view", "/knowledgebase", "rp=/knowledgebase", "/login", "clientarea.php", "register", "/clientarea/", "/affiliates/", "/tickets/", "/chat/", "/userapi/", "/status/", "/signup/", "action=passreminder"]
CLICK_HINTS = ["cart", "store", "products", "pricing", "gid=", "fid=", "cat_id="]
PHP_LISTING_PARTS = ["vps", "server", "cloud", "resources", "vds"]
HOSTBILL_URL_MARKERS = ["index.php?/cart/", "?/cart/", "action=add&id=", "cat_id=", "fid="]
WHMCS_URL_MARKERS = ["cart.php", "rp=/store", "a=add&pid=", "gid="]
HOSTBILL_PAGE_MARKERS = ["index.php?/cart/", "?/cart/", "action=add&id=", "cat_id=", 'name="id"', "name='id'", "/cart/&step="]
WHMCS_PAGE_MARKERS = ["whmcs", "cart.php", "rp=/store"]

# --- fetching ----------------------------------------------------------
BLOCKED_STATUS = [429, 520, 521, 522, 523, 525, 526]
RETRY_STATUS = [408, 425, 429]
STOP_REASONS = ["deadline", "max_pages", "fetch_error_streak", "no_new_pages_streak", "max_products", "queue_exhausted"]
INCOMPLETE_REASONS = ["deadline", "max_pages", "fetch_error_streak", "no_new_pages_streak"]

#: Marks of an edge server's challenge: all words of a line must be on the page.
CHALLENGE_STATUS = [520, 521, 522, 523, 525, 526]
CHALLENGE_PATH = "/cdn-cgi/"
CHALLENGE_PATH_MARKS = ["challenge-platform", "cf-chl", "__cf_chl", "jschl", "turnstile", "cf-turnstile"]
CHALLENGE_PHRASES = [("just a moment", "cloudflare"), ("just a moment", "checking your browser"), ("attention required", "cloudflare")]
CHALLENGE_REFUSALS = [403, 429, 503]
CHALLENGE_HEADERS = ["cf-ray", "cf-cache-status"]
#: What candidate pages are worth: parts of the address in lower case (any of a line), and ends.
CANDIDATE_PARTS = [(["/products/cart/"], -1), (["rp=/store", "/store/"], 2), (["?/cart/", "/cart/"], 2), (["/products/"], 2), (["cart.php?gid="], 2), (["/pages/pricing"], 1)]
CANDIDATE_ENDS = [("/cart.php", 1), ("/pricing", 1)]
#: Sold-out elements of a detail page: whole classes, and parts of the class attribute; marks of an order form.
SOLD_CLASSES = ["outofstock", "out-of-stock", "soldout"]
SOLD_CLASS_PARTS = ["outofstock", "soldout", "unavailable"]
ORDER_FORM_MARKS = ["billingcycle", "configoption[", "custom["]

# --- pages that miss a product -----------------------------------------
MISS_PID = ["product does not exist", "not found", "invalid product", "no product selected"]
MISS_GID = ["not found", "invalid", "no product groups found", "no products found", "no products"]
MISS_HOSTBILL_ID = ["not found", "invalid", "product does not exist", "no product selected"]
MISS_HOSTBILL_GROUP = ["not found", "invalid", "no products"]

# --- specifications: first matching pattern per key wins -----------------
SPEC_PATTERNS = {
    "RAM": [
        r"\b(\d{1,5}(?:\.\d+)?)\s*(?:TB|T|GB|G|MB|M)\s*(?:DDR\d\s*)?(?:RAM|vRAM|Memory|Mem|內存|内存|記憶體|记忆体)\b",
        r"\b(?:ram|memory|mem|內存|内存|記憶體|记忆体)\s*(?:[:：-]|\s)\s*(\d{1,5}(?:\.\d+)?)\s*(?:TB|T|GB|G|MB|M)\b",
    ],
    "CPU": [
        r"\b(\d{1,3})\s*x?\s*(?:vCPU|vCore|CPU|Core|Cores|核心|核)\b",
        r"\b(\d{1,3})\s*x?\s*(?:[a-z0-9]+\s+){0,4}(?:core|cores)\b",
        r"\b(\d{1,3})\s*v\s*(?:dedicated\s*)?cpu\b",
        r"\bcpu\s*(?:[:：-]|\s)\s*(\d{1,3})\s*x?\s*(?:[a-z0-9]+\s+){0,4}(?:core|cores|vcore|vcpu)\b",
        r"\b(?:cpu|vcpu|vcore|core|cores|核心|核)\s*[:：]?\s*(\d{1,3})\s*x?\b",
    ],
    "Disk": [
        r"\b(\d{1,5}(?:\.\d+)?)\s*(?:TB|GB|MB)\s*(?:SSD|NVME|HDD|Disk|Storage|硬盤|硬盘|磁盤|磁盘)\b",
        r"\b(?:disk|storage|ssd|nvme|hdd|硬盤|硬盘|磁盤|磁盘)\s*[:：]?\s*(\d{1,5}(?:\.\d+)?)\s*(?:TB|GB|MB)\b",
    ],
    "Bandwidth": [
        r"\b(\d{1,6}(?:\.\d+)?)\s*(?:TB|T|GB|G|MB|M)\s*(?:bandwidth)\b",
        r"\b(?:bandwidth)\s*[:：]?\s*(\d{1,6}(?:\.\d+)?)\s*(?:TB|T|GB|G|MB|M)\b",
    ],
    "Traffic": [
        r"\b(\d{1,6}(?:\.\d+)?)\s*(?:TB|T|GB|G|MB|M)\s*(?:/\s*(?:month|mo|monthly|月))\b",
        r"\b(\d{1,6}(?:\.\d+)?)\s*(?:TB|T|GB|G|MB|M)\s*(?:traffic|transfer|data\s*transfer|流量)\b",
        r"\b(\d{1,6}(?:\.\d+)?)\s*(?:TB|T|GB|G|MB|M)\s*(?:monthly|month|per\s*month)?\s*(?:bandwidth|traffic|transfer)\b",
        r"\b(?:traffic|transfer|data\s*transfer|流量|bandwidthtraffic)\s*[:：]?\s*(\d{1,6}(?:\.\d+)?)\s*(?:TB|T|GB|G|MB|M)(?:\s*/\s*(?:month|mo|monthly|月))?\b",
        r"\b(?:traffic(?:/speed)?|transfer(?:/speed)?|data\s*transfer)\s*(?:[:：-]|\s)\s*(\d{1,6}(?:\.\d+)?)\s*(?:TB|T|GB|G|MB|M)\b",
    ],
    "Port": [
        r"\b(\d{1,5}(?:\.\d+)?)\s*(?:Mbps|Gbps)\b",
        r"\b(?:port|network|網絡|网络)\s*[:：]?\s*(\d{1,5}(?:\.\d+)?)\s*(?:Mbps|Gbps)\b",
    ],
}
SPEC_NOISE = ["bandwidth", "traffic", "transfer", "bandwidthtraffic", "/month", "/mo", "/monthly", "/月"]

# --- product cards -----------------------------------------------------
CARD_CLASSES = ["package", "product", "plan", "pricing", "card", "tt-single-product", "cart-product", "cartitem", "cartbox", "bordered-section"]
CARD_CLASS_PARTS = ["plan", "product", "package", "pricing", "card"]
#: Cards that are never widened to an element around them.
WHOLE_CARD_PARTS = ["cart-product", "cartitem", "cartbox"]
CARD_LINK_PARTS = ["a=add", "pid=", "/checkout", "/products/", "/store/", "/cart/"]
CARD_TAGS = ["form", "div", "li", "article", "section"]
LINK_HINTS = ["cart", "order", "buy", "checkout", "product", "plan", "package"]
BUY_LABELS = ["buy", "order", "checkout", "cart", "add", "subscribe", "continue", "立即", "訂購", "購買", "购买", "下单"]
#: Where a card's name stands, the best first: tags, id endings, classes, parts of the class attribute.
NAME_TAGS_FIRST, NAME_ID_END, NAME_TAG_THEN = ["h1", "h2", "h3", "h4"], "name", "nobr"
NAME_CLASSES = ["title", "name", "product-name", "producttitle", "product-title", "plan-title", "card-title", "tt-product-name"]
NAME_CLASS_PARTS, NAME_TAG_LAST = ["title", "name"], "strong"
FORM_NAME_WORDS = ["continue", "monthly", "quarterly", "annually", "semi", "biennially", "triennially"]
#: Labels of buttons; the last is one only where a name is judged.
ACTION_LABELS = [
    "buy", "order", "checkout", "cart", "learn more", "details", "view", "continue",
    "立即订购", "立即購買", "立即购买", "立即訂購", "加入购物车", "加入購物車", "查看购物车", "查看購物車", "购物车", "購物車",
]
ACTION_NAME = "get started"
NON_NAME_PHRASES = ["total due today", "subtotal", "proceed to checkout", "your cart is empty", "get started", "not transferable"]
NON_NAMES = ["cart", "products", "store"]
NON_NAME_MARKS = ["默认配置", "請下單時自行加配", "请下单时自行加配"]
GENERIC_NAME_MARKS = ["标价为实际价格", "鏍囦环涓哄疄闄呬环鏍", "套餐与价格", "濂楅\ue635涓庝环鏍", "product price", "pricing"]
LEAD_NO_NAMES = ["CPU", "KVM", "IPV4", "IPV6", "SSD", "HDD", "CNY", "USD", "GB", "TB"]
NAME_PRICE = r"(?iU)(?:HK\$|US\$|NT\$|\$|€|£|¥|￥|元|USD|EUR|GBP|HKD|CNY|RMB|JPY|TWD)\s*\d"
NAME_TAIL = r"(?iuU)(?:\b\d+\s*(?:available|left|in\s*stock)\b|\bavailable\b|可用|库存|庫存)\s*$"
NAME_STOCK_LEAD = r"(?iU)^(?:out of stock|sold out|in stock)\s+"
NAME_CYCLES = ["Monthly", "Per Month", "每月"]
DESCRIPTION_CLASSES = ["description", "desc", "product-description", "plan-description"]
STOCK_CLASSES, STOCK_CLASS_PARTS = ["stock", "availability"], ["stock", "avail"]
CARD_SOLD_PARTS = ["sold", "soldout", "out-of-stock", "outofstock", "unavailable"]
CARD_BUY_LABELS, CARD_BUY_CLASSES = ["buy", "order", "checkout", "add", "订购", "訂購", "购买", "購買"], ["buy", "order", "checkout", "cart", "add"]
CARD_BUY_TARGETS, CARD_NO_TARGETS = ["action=add", "a=add", "pid=", "id=", "product=", "product_id="], ["a=view", "domain=register", "domain=transfer"]
#: Links of cards that sell nothing: parts of the path.
CARD_NO_PRODUCT_PATHS = [
    "clientarea.php", "submitticket.php", "announcements", "knowledgebase", "downloads", "serverstatus", "register", "login", "affiliates",
    "contact", "about", "privacy", "terms", "tos", "changelog", "refund", "protocol", "faq", "blog", "product/buyvm",
]
#: Addresses that stand for the site's root although no slash is before them.
ROOTED = ["cart/", "products/", "store/", "billing/", "cart.php", "index.php?/cart/", "index.php?/products/", "index.php?rp=/store"]
LOCATION_SPECS = ["Location", "Datacenter", "Data Center", "Region", "Zone", "Node"]
#: Keys of specifications: the whole key, else the first of these that it holds.
SPEC_KEYS = {
    "cpu": "CPU", "vcpu": "CPU", "core": "CPU", "cores": "CPU", "核心": "CPU",
    "ram": "RAM", "memory": "RAM", "mem": "RAM", "內存": "RAM", "内存": "RAM", "記憶體": "RAM", "记忆体": "RAM",
    "disk": "Disk", "storage": "Disk", "硬盘": "Disk", "硬盤": "Disk", "磁盘": "Disk", "磁盤": "Disk",
    "bandwidth": "Bandwidth", "traffic": "Traffic", "transfer": "Traffic", "流量": "Traffic",
    "port": "Port", "network": "Port", "網絡": "Port", "网络": "Port", "帶寬": "Bandwidth", "带宽": "Bandwidth", "端口": "Port",
    "库存": "Stock", "ip 地址": "IPv4", "ip地址": "IPv4", "ipv4": "IPv4", "ipv6": "IPv6",
    "location": "Location", "datacenter": "Datacenter", "data center": "Datacenter", "region": "Region", "zone": "Zone", "node": "Node",
}
SPEC_LINE_STOPS = ["buy now", "order now", "add to cart", "立即購買", "立即购买", "立即訂購", "立即订购", "checkout"]
SPEC_VALUE_WORDS = ["cpu", "core", "vcpu", "vcore", "ram", "memory", "disk", "ssd", "nvme", "hdd", "gb", "tb", "mb", "mbps", "gbps", "traffic", "bandwidth", "transfer", "ipv4", "ipv6"]
SPEC_PAIRS = r"(?U)([A-Za-z0-9\u4e00-\u9fff ]{1,24})\s*[:：]\s*([^:：]{1,40})(?=(?:\s+[A-Za-z0-9\u4e00-\u9fff ]{1,24}\s*[:：])|$)"
SPEC_LINE_CLASSES = ["cart-product-section"]
#: Cards of a page, of one with so many characters or more, and links that are looked at.
MOST_CARDS, MOST_CARDS_LARGE, LARGE_PAGE, MOST_CARD_LINKS, MOST_SPEC_LINES, MOST_PLAIN_LINES = 900, 400, 600_000, 300, 24, 8

# --- listings by id, and tables of plans --------------------------------

LISTING_ITEM, LISTING_BOX, LISTING_SOLD, LISTING_TITLE, LISTING_PRICE = "cart-products-item", "cart-products-box", "none-stock", "cart-products-title", "cart-products-price"
#: Features: of the first class, entries of lists of the second, of the third class.
LISTING_FEATURES = ["cart-products-feature", "cart-products-features", "product-feature"]
PLAN_ROW, PLAN_LINK = "table-row", "/billing/store/"
PLAN_CELLS = ["Disk", "CPU", "RAM", "Traffic", "Port", "OS"]
PRICE_MARKS = ["$", "€", "£", "USD", "EUR", "GBP", "CNY", "HK$", "¥", "￥", "CN¥"]
PLAN_BUTTONS = ["order", "buy", "buy now", "checkout", "select"]
