"""Names and formats that must equal the reference's for results to line up.

Everything else in the package is a parameter; these are the defaults that
make a user's existing inputs and result names work unchanged.
"""

from __future__ import annotations

# --- Fixed values (from the reference) ------------------------------------
# Case table: the five analysed columns, in the order they are selected.
CASE_COLUMNS = ["Case_Type", "Cases", "iso3", "Population_Count", "Date"]
# Case types that are analysed.
CONFIRMED = "Confirmed"
DEATHS = "Deaths"
# Date text in the case file.
CASE_DATE_PATTERN = "MM/dd/yyyy"
# Key column of the indicator tables.
COUNTRY_CODE = "Country Code"
# Result columns.
NUMBER_OF_CASES = "Number_Of_Cases"
NUMBER_OF_DEATHS = "Number_Of_Deaths"
POPULATION = "Population"
NUMBER_OF_COUNTRIES = "Number_Of_Countries"
NEW_CASES = "Number of New Cases"
# Factor labels (year filled in).
EXPENDITURE_LABEL = "Health Expenditure Percentage of GDP in {year}"
ARRIVALS_LABEL = "Number of Arrivals in {year}"
# Printed report line (factor, measure, value).
REPORT_FORMAT = "The correlation between %s and %s is: %s"
# --- end of fixed values ----------------------------------------------------
