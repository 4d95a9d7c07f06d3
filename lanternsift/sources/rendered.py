"""Rendered documents with planted identifiers: text and truth both follow from a key, in SQL that any engine runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def pad(expr: str, n: int) -> str:
    return f"lpad(CAST({expr} AS STRING), {n}, '0')"


def digit_sum(text: str, weights: list[int]) -> str:
    return " + ".join(f"{w} * CAST(substr({text}, {i}, 1) AS INT)" for i, w in enumerate(weights, 1) if w)


def luhn_sum(text: str, n: int) -> str:
    """Sum of a number of n digits whose every second digit from the right but one is doubled."""
    one = lambda i: f"CAST(substr({text}, {i}, 1) AS INT)"
    return " + ".join(one(i) if (n - i) % 2 == 0 else f"(CASE WHEN {one(i)} > 4 THEN 2 * {one(i)} - 9 ELSE 2 * {one(i)} END)" for i in range(1, n + 1))


@dataclass(frozen=True)
class Plant:
    """SQL over k: what stands before the identifier, the identifier, after it, when it is valid, and its confidence."""

    type: str
    before: str
    ident: str
    after: str = "' thanks'"
    valid: str = "TRUE"
    confidence: str = "0.9"

    def inner(self, table: str = "customer", key: str = "c_custkey") -> str:
        return f"(SELECT k AS doc_id, k, {self.before} AS b, {self.ident} AS i, {self.after} AS a FROM (SELECT CAST({key} AS BIGINT) AS k FROM {table}) AS keys)"

    def docs(self) -> str:
        return f"SELECT doc_id, i AS ident, b || i || a AS text FROM {self.inner()} AS p"

    def truth(self) -> str:
        return (
            f"SELECT doc_id, '{self.type}' AS type, CAST(length(b) AS INTEGER) AS start, CAST(length(b) + length(i) AS INTEGER) AS \"end\", i AS text, "
            f"CAST({self.confidence} AS DOUBLE) AS confidence FROM {self.inner()} AS p WHERE {self.valid}"
        )

    def checks(self) -> str:
        return f"SELECT doc_id, i AS ident, {self.valid} AS ok FROM {self.inner()} AS p"


_name = "CASE WHEN k % 3 = 0 THEN 'Mary Smith' WHEN k % 3 = 1 AND k % 2 = 1 THEN 'James Q. Public' ELSE 'Linda Garcia' END"
_unissued = "'00', '07', '08', '09', '17', '18', '19', '28', '29', '49', '69', '70', '78', '79', '89', '96', '97'"
PLANTS = {
    "email": Plant("EMAIL", "'mail '", "CASE WHEN k % 7 = 0 THEN '.' ELSE '' END || 'user' || CAST(k AS STRING) || '@mail.example.org'", valid="k % 7 <> 0", confidence="0.95"),
    "phone": Plant("PHONE_US", "'call '", f"'(' || {pad('100 + k % 900', 3)} || ') ' || {pad('k % 1000', 3)} || '-' || {pad('k % 10000', 4)}", valid="substr(i, 2, 1) >= '2' AND substr(i, 7, 1) >= '2'", confidence="0.85"),
    "ssn": Plant("SSN", "'number '", f"{pad('(k * 7) % 1000', 3)} || '-' || {pad('k % 100', 2)} || '-' || {pad('(k * 13) % 10000', 4)}", valid="substr(i, 1, 3) NOT IN ('000', '666') AND substr(i, 1, 3) < '900' AND substr(i, 5, 2) <> '00' AND substr(i, 8, 4) <> '0000'"),
    "licence": Plant("US_DRIVER_LICENSE", "'driver license no: '", f"'D' || {pad('k', 7)}", confidence="0.8"),
    "card": Plant("CREDIT_CARD", "'pay '", f"CASE WHEN k % 2 = 0 THEN '4' ELSE '9' END || {pad('k * 97', 15)}", valid=f"({luhn_sum('i', 16)}) % 10 = 0", confidence="CASE WHEN k % 2 = 0 THEN 0.95 ELSE 0.8 END"),
    "account": Plant("ACCOUNT_NUMBER", "'account no: '", pad("k", 9), confidence="0.8"),
    "ipv4": Plant("IP_ADDRESS", "CASE WHEN k % 5 = 0 THEN 'version ' ELSE 'at ' END", "CAST(k % 300 AS STRING) || '.0.10.' || CAST(k % 256 AS STRING)", "'.'", "k % 300 <= 255 AND k % 5 <> 0", "0.7"),
    "ipv6": Plant("IP_ADDRESS", "'host '", "'2001:db8:' || CASE WHEN k % 4 = 0 THEN '::' ELSE ':' END || CAST(k % 10000 AS STRING)", valid="k % 4 <> 0", confidence="0.7"),
    "url": Plant("URL", "'see '", "'https://www.example.com/c/' || CAST(k AS STRING) || '?q=1'", "'.'", confidence="0.85"),
    "dob": Plant("DATE_DOB", "CASE WHEN k % 6 = 0 THEN 'seen ' ELSE 'DOB: ' END", f"{pad('k % 14', 2)} || '/' || {pad('k % 29', 2)} || '/' || CAST(1890 + k % 110 AS STRING)", valid="k % 14 BETWEEN 1 AND 12 AND k % 29 >= 1 AND k % 110 >= 10 AND k % 6 <> 0"),
    "health_plan": Plant("HEALTH_PLAN_ID", "CASE WHEN k % 3 = 0 THEN 'gym member id: ' ELSE 'insurance member id: ' END", f"'HP' || {pad('k', 7)}", valid="k % 3 <> 0", confidence="0.8"),
    "mrn": Plant("MRN", "CASE WHEN k % 3 = 0 THEN 'the chart ' ELSE 'MRN: ' END", "CAST(1000000 + k AS STRING)", valid="k % 3 <> 0", confidence="0.85"),
    "routing": Plant("BANK_ROUTING", "'routing number '", pad("(k * 104729) % 1000000000", 9), valid=f"({digit_sum('i', [3, 7, 1] * 3)}) % 10 = 0"),
    "vin": Plant("VEHICLE_ID", "'car '", f"'11111111' || CAST(k % 10 AS STRING) || '11' || {pad('k % 1000000', 6)}", valid=f"(62 + {digit_sum('substr(i, 12, 6)', [7, 6, 5, 4, 3, 2])}) % 11 = k % 10"),
    "swift": Plant("SWIFT_BIC", "'SWIFT code '", f"'DEUTDE' || {pad('k % 100', 2)}", confidence="0.85"),
    "mac": Plant("MAC_ADDRESS", "'on '", f"'00:1B:44' || CASE WHEN k % 3 = 0 THEN '-' ELSE ':' END || '11:' || {pad('k % 100', 2)} || ':' || {pad('(k * 3) % 100', 2)}", valid="k % 3 <> 0"),
    "fax": Plant("FAX_NUMBER", "CASE WHEN k % 2 = 0 THEN 'fax ' ELSE 'ring ' END", f"'415-555-' || {pad('k % 10000', 4)}", valid="k % 2 = 0"),
    "tax_id": Plant("TAX_ID", "'EIN '", f"{pad('k % 100', 2)} || '-' || {pad('k', 7)}", valid=f"substr(i, 1, 2) NOT IN ({_unissued})", confidence="0.85"),
    "address": Plant("ADDRESS", "'lives at '", "CAST(1 + k % 9999 AS STRING) || ' Maple Hill Street, Boston'", "' now'", confidence="0.85"),
    "name": Plant("PERSON_NAME", "CASE WHEN k % 2 = 0 THEN 'met Dr. ' ELSE 'met ' END", _name, "' today'", confidence="0.8"),
}


def rendered(spark: SparkSession, sf_dir: str, plant: Plant) -> DataFrame:
    """doc_id, ident and text, one row a customer."""
    spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey").createOrReplaceTempView("_plant_customer")
    return spark.sql(plant.docs().replace("FROM customer", "FROM _plant_customer"))
