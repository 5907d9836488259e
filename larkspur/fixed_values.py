"""Fixed values that results depend on: tables, sets, formats and patterns, in one place."""

from __future__ import annotations

# --- fixed values: rating scales, best first; the place in the list is the level ---
SP_SCALE = ("AAA", "AA+", "AA", "AA-", "A+", "A", "A-", "BBB+", "BBB", "BBB-", "BB+", "BB", "BB-", "B+", "B", "B-", "CCC+", "CCC", "CCC-", "CC", "C", "D")
MOODYS_SCALE = ("Aaa", "Aa1", "Aa2", "Aa3", "A1", "A2", "A3", "Baa1", "Baa2", "Baa3", "Ba1", "Ba2", "Ba3", "B1", "B2", "B3", "Caa1", "Caa2", "Caa3", "Ca", "C", "D")
#: Order in which rating text is searched for S&P tokens.
SP_TEXT_ORDER = ("AAA", "AA+", "AA", "AA-", "A+", "A", "A-", "BBB+", "BBB", "BBB-", "BB+", "BB", "BB-", "B+", "B", "B-", "CCC+", "CCC", "CCC-", "CC", "C")

# --- fixed values: price clusters (lower bound, name) ---
PRICE_CLUSTERS = ((0, "Deep Discount"), (70, "Discount"), (95, "Par"), (105, "Premium"), (120, "High Premium"))

# --- fixed values: payment frequency texts, exact, then contained, in order ---
FREQUENCY_EXACT = (("annual", 1), ("semi-annual", 2), ("semi annual", 2), ("quarterly", 4), ("monthly", 12), ("zero", 0), ("zero coupon", 0))

# --- fixed values: patterns of treasury records ---
TREASURY_PATTERNS = (r"\bUST\b", r"\bTREASURY\b", r"\bUNITED STATES TREASURY\b", r"\bUS-T\b", r"\bT-?NOTE\b", r"\bT-?BOND\b", r"\bU\.?S\.?\s+GOVT\b")

# --- fixed values: patterns of bond descriptions: coupon with a percent sign, coupon without one, maturities, ISIN, ratings ---
COUPON_PERCENT = r"(?<![\d.])(\d+(?:\.\d+)?|\d+\s+\d+/\d+)\s*%"
COUPON_PLAIN = r"(?<![/\d])\d+(?:\s+\d+/\d+|\.\d+)?(?![/\d])"
MATURITY_SPELLED = r"([A-Za-z]{3})(\d{2})'?(\d{2})"
MATURITY_SLASHED = r"(?<![Dd])(\d{2})/(\d{2})/(\d{2,4})"
ISIN = r"\b[A-Z]{2}[A-Z0-9]{10}\b"
RATING_PAIR = r"\b([A-Z]{1,4}[+-]?\d?/[A-Z]{1,4}[+-]?\d?)\b"

# --- fixed values: risk weights and jurisdictions ---
RISK_WEIGHTS = {"customer": 0.30, "jurisdiction": 0.25, "product": 0.15, "delivery": 0.15, "introducer": 0.15}
EU_COUNTRIES = ("AUT", "BEL", "BGR", "HRV", "CYP", "CZE", "DNK", "EST", "FIN", "FRA", "DEU", "GRC", "HUN", "IRL", "ITA", "LVA", "LTU", "LUX", "MLT", "NLD", "POL", "PRT", "ROU", "SVK", "SVN", "ESP", "SWE")
LOW_RISK = ("USA", "GBR", "VGB", *EU_COUNTRIES)
WELL_REGULATED = ("AUS", "CAN", "CHL", "COL", "CRI", "ISL", "ISR", "JPN", "KOR", "MEX", "NZL", "NOR", "CHE", "TUR", "SGP")
HIGH_RISK = ("AFG", "MMR", "YEM", "SSD", "SOM", "COD", "IRQ", "LBN", "NGA", "PAK", "SYR", "VEN")
SANCTIONED = ("IRN", "PRK", "CUB", "RUS", "BLR")
FATF_CODES = ("AGO", "BOL", "BGR", "CMR", "CIV", "COD", "DZA", "HTI", "IRN", "KEN", "KWT", "LAO", "LBN", "MCO", "MMR", "NAM", "NPL", "PNG", "PRK", "SSD", "SYR", "VEN", "VGB", "VNM", "YEM")
FATF_NAMES = (
    "ALGERIA", "ANGOLA", "BOLIVIA", "BULGARIA", "CAMEROON", "COTE D IVOIRE", "DEMOCRATIC PEOPLE S REPUBLIC OF KOREA", "DEMOCRATIC REPUBLIC OF CONGO", "HAITI", "IRAN", "KENYA", "KUWAIT",
    "LAO PEOPLE S DEMOCRATIC REPUBLIC", "LEBANON", "MONACO", "MYANMAR", "NAMIBIA", "NEPAL", "PAPUA NEW GUINEA", "SOUTH SUDAN", "SYRIA", "VENEZUELA", "VIETNAM", "VIRGIN ISLANDS UK", "YEMEN",
)
SIMPLE_PRODUCTS, DERIVATIVE_PRODUCTS, COMPLEX_PRODUCTS = ("STK", "BOND", "FUND", "CASH", "ETF"), ("OPT", "FUT"), ("CFD", "WAR", "SSF", "FOP", "COMB", "MRGN")
RISKY_PRODUCT_WORDS, ADVERSE_WORDS = "CRYPTO|PRIVATE|UNREGULATED|OMNIBUS", "SANCTION|ADVERSE|CRIME|CRIMINAL|FRAUD|AML|TERROR|OFAC"
CUSTOMER_TYPES = ("INDIVIDUAL", "JOINT", "ORG")

# --- fixed values: risk archetypes (id, name, treasuries, bonds_aaa_a, bonds_bbb, bonds_bb, etfs, min_score, max_score) ---
ARCHETYPES = (
    (1, "Conservative A", 0.5, 0.15, 0.35, 0.0, 0.0, 0.0, 0.9),
    (2, "Conservative B", 0.0, 0.18, 0.54, 0.08, 0.2, 0.9, 1.25),
    (3, "Moderate A", 0.0, 0.104, 0.312, 0.234, 0.35, 1.25, 1.5),
    (4, "Moderate B", 0.0, 0.0, 0.25, 0.25, 0.5, 1.5, 2.0),
    (5, "Moderate C", 0.0, 0.0, 0.16, 0.24, 0.6, 2.0, 2.5),
    (6, "Aggressive A", 0.0, 0.0, 0.075, 0.175, 0.75, 2.5, 2.75),
    (7, "Aggressive B", 0.0, 0.0, 0.04, 0.16, 0.8, 2.75, 3.0),
    (8, "Aggressive C", 0.0, 0.0, 0.0, 0.0, 1.0, 3.0, 10.0),
)
TOP_SCORE = 10.0
TOTAL_ASSETS = 20
BUCKETS = ("cash", "treasuries", "bonds_aaa_a", "bonds_bbb", "bonds_bb", "etfs", "stocks", "bonds")

# --- fixed values: market-data column renames and wire codes ---
QUOTE_RENAMES = {"Company_name": "Company Name", "Bid_size": "Bid Size", "Bid_price": "Bid", "Bid_yield": "Bid Yield", "Ask_size": "Ask Size", "Ask_price": "Ask", "Ask_yield": "Ask Yield", "Issue_date": "Issue Date", "Last_trading_date": "Last Trading Date"}
#: Wire codes of quote fields that the engine reads; others keep their number.
QUOTE_FIELDS = {31: "LAST_PRICE", 55: "SYMBOL", 58: "TEXT", 70: "HIGH", 71: "LOW", 73: "MARKET_VALUE", 74: "AVG_PRICE", 75: "UNREALIZED_PNL", 78: "DAILY_PNL", 79: "REALIZED_PNL", 82: "CHANGE"}

# --- fixed values: control records of report files, statement section, sanctions list columns ---
CONTROL_RECORDS = ("BOA", "BOF", "BOS", "EOS", "EOA", "EOF", "MSG")
STATEMENT_SECTION = "Change in NAV"
OFAC_COLUMNS = ("entity_number", "name", "type", "program", "title", "call_sign", "vessel_type", "tonnage", "gross_registered_tonnage", "vessel_flag", "vessel_owner", "more_info")
UK_HEADER = "Last Updated,Unique ID,"

# --- fixed values: text-recognition quality ---
CONFIDENCE_IF_UNKNOWN, LOW_REGION_CONFIDENCE, RETRY_CONFIDENCE = 0.85, 0.50, 0.65
HIGH_SCORE, REVIEW_SCORE = 80.0, 50.0
REVIEW_PROVIDER_QUALITY, LOW_PROVIDER_QUALITY, REVIEW_DEFECT, LOW_DEFECT = 0.65, 0.40, 0.80, 0.85
SEVERE_DEFECTS = ("quality/defect_blurry", "quality/defect_dark", "quality/defect_faint", "quality/defect_noisy", "quality/defect_text_too_small")
REVIEW_DEFECTS = ("quality/defect_glare", "quality/defect_text_cutoff")
PAGES_A_CHUNK = 15

# --- fixed values: translation ---
CHUNK_CHARS, GLOSSARY_CHARS, GLOSSARY_ENTRIES, GLOSSARY_LINE = 2200, 8000, 100, 120
LEAK_MARKERS = ("SPANISH SOURCE:", "ENGLISH TRANSLATION:", "--- TRANSLATION EXAMPLE ---", "--- GLOSSARY START ---", "--- GLOSSARY END ---", "--- DOCUMENT START ---", "--- DOCUMENT END ---")
TERMINAL_FAILURES = (
    "Unsupported OCR mime type:", "Failed to load document (PDFium: Incorrect password error)", "Failed to load document (PDFium: Data format error)", "Failed to open image for OCR:",
    "document data is empty", "document data is not valid base64", "document not found:", "contact_document has no document_id",
)
#: Values that are not translated, in the order in which they are masked.
PROTECTED_PATTERNS = (
    r"(?m)^[A-Z0-9<]{30,}$",
    r"(?im)^.*(?:digitally signed by|firmado digitalmente por|\(firma\)).*$",
    r"(?im)^[^\n]{1,120}\b(?:S\.?\s*R\.?\s*L\.?|S\.?\s*A\.?|L\.?L\.?C\.?|I\.?N\.?C\.?)$",
    r"\b(?:Lcda|Lcdo|Sr|Sra|Dr|Dra)\.[ \t]+[A-ZÁÉÍÓÚÜÑ][a-záéíóúüñ]+(?:[ \t]+[A-ZÁÉÍÓÚÜÑ][a-záéíóúüñ]+){1,4}\b",
    r"(?i)\b(?:\d{1,2}\s+DE\s+)?(?:enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|setiembre|octubre|noviembre|diciembre)(?:\s+DE(?:L)?\s+|\s+)\d{4}\b",
    r"\b(?=[A-Z0-9._/-]{4,}\b)(?=[A-Z0-9._/-]*[A-Z])(?=[A-Z0-9._/-]*\d)[A-Z0-9]+(?:[._/-][A-Z0-9]+)+\b",
    r"(?<![\w])(?:[₡$€£]\s*)?[-+]?\d[\d.,'/:+-]*(?:\s*%)?(?![\w])",
)
PAGE_COUNTER = r"(?i)Page\s+\d+\s+of\s+\d+"
PLACEHOLDER = "ZZX9{:04d}8XZZ"

# --- fixed values: requests for missing documents ---
REQUEST_FIELDS = ("account_id", "contact_id", "recipient_email", "recipient_source", "language", "content")
RECIPIENT_SOURCES, REQUEST_LANGUAGES, REQUEST_KEYS = ("contact", "ibkr", "testing"), ("en", "es"), ("poi", "poe", "poa", "sow")

# --- fixed values: columns of a trade confirmation, in order; a blank line follows those in the second list ---
TICKET_COLUMNS = (
    "ClientAccountID", "AccountAlias", "CurrencyPrimary", "AssetClass", "Symbol", "Description", "Conid", "SecurityID", "SecurityIDType", "CUSIP", "ISIN", "FIGI", "Issuer", "Maturity",
    "Buy/Sell", "SettleDate", "TradeDate", "Exchange", "Quantity", "AccruedInterest", "Accrued (Days)", "Price", "Price (including Commissions)", "Amount", "TotalAmount",
)
TICKET_BREAKS = ("FIGI", "CurrencyPrimary")

# --- fixed values: columns of the open-positions template: those of the report, then those that are left blank for formulas ---
POSITION_COLUMNS = (
    "ClientAccountID", "AccountAlias", "Model", "CurrencyPrimary", "FXRateToBase", "AssetClass", "Symbol", "Description", "Conid", "SecurityID", "SecurityIDType", "CUSIP", "ISIN",
    "ListingExchange", "UnderlyingConid", "UnderlyingSymbol", "UnderlyingSecurityID", "UnderlyingListingExchange", "Issuer", "Multiplier", "Strike", "Expiry", "Put/Call",
    "PrincipalAdjustFactor", "ReportDate", "Quantity", "MarkPrice", "PositionValue", "PositionValueInBase", "OpenPrice", "CostBasisPrice", "CostBasisMoney", "PercentOfNAV",
    "FifoPnlUnrealized", "UnrealizedCapitalGainsPnl", "UnrealizedFxPnl", "Side", "LevelOfDetail", "OpenDateTime", "HoldingPeriodDateTime", "Code", "OriginatingOrderID",
    "OriginatingTransactionID", "AccruedInterest", "VestingDate", "SerialNumber", "DeliveryType", "CommodityType", "Fineness", "Weight",
)
FORMULA_COLUMNS = (
    "KEY", "securities_bond row", "Maturity", "Coupon", "Sector", "Frequency", "Open Date", "Column5", "Column6", "Tasa", "Column7", "Meses en Cartera",
    "Rendimiento Acumulado x Cupón", "Current Price - 100", "Duraciones", "MDURATION", "DURATION", "Column8", "Market Price", "Yield", "Rate", "RTD MATCH CONID", "RTD Duration",
    "RTD Bid", "RTD Ask", "RTD Credit Rating", "RTD Credit Rating Level", "RTD Ask Value", "a", "a2", "Change in Price + Accrued Interest Received", "Year on Portfolio",
    "Yield (Price + Interest)", "a3", "Duration FX", "Coupon * Quantity", "Credit Rating Main Class", "Investment Grade Amt", "Column1", "Issuer FX",
)
