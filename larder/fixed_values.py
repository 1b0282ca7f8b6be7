"""Names, labels and conversion rules that define the results."""

# The published column order of the clean price table.
CLEAN_FOOD = (
    "country", "country_code", "country_income_group", "region", "city", "market",
    "date", "year", "month", "seller_type", "import", "food_group", "food_name",
    "price_per_one_unit", "unit_type", "price", "unit", "currency",
    "unified_price", "ppp_factor",
)

# Raw column name -> clean column name.
RAW_FOOD_NAMES = {
    "adm0_name": "country",
    "adm1_name": "city",
    "mkt_name": "market",
    "cm_name": "food_name",
    "cur_name": "currency",
    "pt_name": "seller_type",
    "um_name": "unit",
    "mp_month": "month",
    "mp_year": "year",
    "mp_price": "price",
}
RAW_FOOD_UNUSED = (
    "mp_commoditysource", "adm0_id", "adm1_id", "mkt_id", "cur_id", "pt_id", "um_id",
    "cm_id",
)
RAW_REGION_NAMES = {
    "code": "country_code",
    "incomegroup": "country_income_group",
    "food_country_name": "country",
}
RAW_PPP_NAMES = {"Country.Name": "country", "Country.Code": "country_code"}

# Currency clean-up.
CURRENCY_UNUSED = ("NumericCode", "MinorUnit", "WithdrawalDate", "Entity")
EXCLUDED_CURRENCY_CODES = ("XXX", "XTS", "BUK", "")
RECODED_CURRENCY = ("Somaliland Shilling", "SOS")

# Labels.
EXCLUDED_FOOD_GROUPS = ("Not Food", "Loaf", "Sack", "Bunch")
NATIONAL_AVERAGE = "National Average"
IMPORT_LABELS = ("Not Import", "Import", "Local")
# The clean table stacks its rows in whole blocks, in this order.
IMPORT_BLOCKS = ("Import", "Not Import", "Local")
SELLER_TYPES = ("Farm Gate", "Producer", "Retail", "Wholesale")
TOP_FOODS = ("Rice", "Maize", "Sorghum", "Beans", "Millet", "Oil")
WORLD_REGIONS = (
    "East Asia & Pacific", "Europe & Central Asia", "Latin America & Caribbean",
    "Middle East & North Africa", "South Asia", "Sub-Saharan Africa",
)
IMPORT_COMPARISON_COUNTRIES = ("Mali", "Guinea", "Chad")
COUNTRIES_WITHOUT_PPP = ("Somalia",)

# The open year interval, the smallest group analysed, the grams of
# rice that give 1,000 calories a day, the histogram's bins.
YEARS_AFTER, YEARS_BEFORE = 1999, 2016
MIN_GROUP_ROWS = 10
RICE_GRAMS_PER_DAY = 769.23076923
HISTOGRAM_BINS = 25

# Unit as published -> "<number> <unit type>".
UNIT_RULES = {
    "11.5 KG": "11500 G",
    "100 KG": "100000 G",
    "91 KG": "91000 G",
    "50 KG": "50000 G",
    "45 KG": "45000 G",
    "1.8 KG": "1800 G",
    "2 KG": "2000 G",
    "5 KG": "5000 G",
    "12.5 KG": "12500 G",
    "1.5 KG": "1500 G",
    "10 KG": "10000 G",
    "12 KG": "12000 G",
    "60 KG": "60000 G",
    "25 KG": "25000 G",
    "3 KG": "3000 G",
    "3.5 KG": "3500 G",
    "90 KG": "90000 G",
    "Cuartilla": "2721.55422 G",
    "MT": "1000000 G",
    "Pound": "453.592 G",
    "Libra": "453.592 G",
    "KG": "1000 G",
    "Marmite": "2500 G",
    "L": "1 L",
    "500 ML": "0.5 L",
    "750 ML": "0.75 L",
    "Gallon": "3.78541 L",
    "Dozen": "12 Unit",
    "Unit": "1 Unit",
    "Head": "1 Unit",
    "Packet": "1 Unit",
    "100 Tubers": "100 Unit",
}

# Exact food names of the four groups that merge several names. A food
# not listed is its own group.
GROUPED_FOOD_NAMES = {
    "Rice": (
        "Rice",
        "Rice (basmatibroken)",
        "Rice (coarse)",
        "Rice (estaquilla)",
        "Rice (glutinousfirst quality)",
        "Rice (glutinoussecond quality)",
        "Rice (glutinousunmilled)",
        "Rice (good quality)",
        "Rice (high qualitylocal)",
        "Rice (high quality)",
        "Rice (local)",
        "Rice (long grain)",
        "Rice (low qualitylocal)",
        "Rice (low quality)",
        "Rice (white)",
        "Rice (tchako)",
        "Rice (medium grain)",
        "Rice (mixedlow quality)",
        "Rice (ordinaryfirst quality)",
        "Rice (ordinarysecond quality)",
        "Rice (ordinaryunmilled)",
        "Rice (paddylong grainlocal)",
        "Rice (paddy)",
        "Rice (red nadu)",
        "Rice (regularmilled)",
        "Rice (small grainimported)",
        "Rice (whiteimported)",
        "Rice (denikassiaimported)",
        "Rice (medium grainimported)",
        "Rice (long grainimported)",
        "Rice (importedEgyptian)",
        "Rice (importedIndian)",
        "Rice (importedTanzanian)",
        "Rice (imported)",
    ),
    "Beans": (
        "Beans",
        "Beans (black)",
        "Beans (butter)",
        "Beans (catarino)",
        "Beans (dry)",
        "Beans (favadry)",
        "Beans (greenfresh)",
        "Beans (kidney red)",
        "Beans (kidney white)",
        "Beans (kidney)",
        "Beans (magnum)",
        "Beans (mung)",
        "Beans (niebe)",
        "Beans (redfresh)",
        "Beans (red)",
        "Beans (silk red)",
        "Beans (string)",
        "Beans (sugar-red)",
        "Beans (sugar)",
        "Beans (white)",
        "Beans(mash)",
    ),
    "Sorghum": (
        "Sorghum",
        "Sorghum (food aid)",
        "Sorghum (red)",
        "Sorghum (taghalit)",
        "Sorghum (white)",
    ),
    "Maize": (
        "Maize",
        "Maize (local)",
        "Maize (white)",
        "Maize (yellow)",
        "Maize meal",
        "Maize meal (local)",
        "Maize meal (whitebreakfast)",
        "Maize meal (whitefirst grade)",
        "Maize meal (whiteroller)",
        "Maize meal (whitewith bran)",
        "Maize meal (whitewithout bran)",
        "Maize (imported)",
    ),
}
