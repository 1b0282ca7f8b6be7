"""Schemas of the input files, as Spark DDL."""

CURRENCY_CODES = (
    "Entity string, Currency string, AlphabeticCode string, NumericCode int, "
    "MinorUnit string, WithdrawalDate string"
)
COUNTRY_REGION = (
    "food_country_name string, code string, incomegroup string, region string, "
    "ppp_country_name string"
)
FOOD_GROUPS = "food_name string, food_group string"
FOOD_RAW = (
    "adm0_id int, adm0_name string, adm1_id int, adm1_name string, mkt_id int, "
    "mkt_name string, cm_id int, cm_name string, cur_id int, cur_name string, "
    "pt_id int, pt_name string, um_id int, um_name string, mp_month int, mp_year int, "
    "mp_price double, mp_commoditysource string"
)
CLEAN_FOOD = (
    "country string, country_code string, country_income_group string, region string, "
    "city string, market string, date date, year int, month string, seller_type string, "
    "import string, food_group string, food_name string, price_per_one_unit double, "
    "unit_type string, price double, unit double, currency string, "
    "unified_price double, ppp_factor double"
)


def ppp_wide(first: int = 1960, last: int = 2016) -> str:
    """Country name and code, two indicator columns, one column per year."""
    years = ", ".join(f"X{year} double" for year in range(first, last + 1))
    return (
        "`Country.Name` string, `Country.Code` string, `Indicator.Name` string, "
        f"`Indicator.Code` string, {years}"
    )
