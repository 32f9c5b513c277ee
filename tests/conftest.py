import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession

CATALOG = (
    "system string, system_ord long, entity string, field string, field_ord int, type string, nullable boolean, pk boolean"
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("plumbline-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    path = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    return path


@pytest.fixture(scope="session")
def catalog(spark):
    """Catalog from ``{system: {entity: ["name type", ...]}}``; ``*`` marks keys."""

    def build(schemas: dict):
        rows = []
        for system_ord, (system, entities) in enumerate(schemas.items()):
            for entity, fields in entities.items():
                for position, text in enumerate(fields):
                    name, _, kind = text.partition(" ")
                    rows.append((system, system_ord, entity, name, position, kind.rstrip("*"), True, kind.endswith("*")))
        return spark.createDataFrame(rows, CATALOG)

    return build


SALESFORCE = {
    "Account": ["Id varchar(18)", "Name varchar(255)", "BillingStreet text", "Phone varchar(40)", "AnnualRevenue decimal", "CreatedDate timestamp"],
    "Contact": ["Id varchar(18)", "AccountId varchar(18)", "FirstName varchar(40)", "LastName varchar(80)", "Email varchar(80)"],
    "Opportunity": ["Id varchar(18)", "AccountId varchar(18)", "Name varchar(120)", "Amount decimal", "CloseDate timestamp", "StageName varchar(40)"],
}
SAP = {
    "KUNNR": ["KUNNR varchar(10)", "NAME1 nvarchar(35)", "NAME2 nvarchar(35)", "TELF1 varchar(16)", "UMSAV numeric(15,2)", "ERDAT varchar(8)"],
    "VBELN": ["VBELN varchar(10)", "KUNNR varchar(10)", "ERDAT varchar(8)", "AUART varchar(4)", "NETWR numeric(15,2)"],
    "Contact": ["PERNR varchar(8)", "NACHN nvarchar(40)", "VORNA nvarchar(40)", "USRID_LONG varchar(82)"],
}
WAREHOUSE = {"Contact": ["contact_id bigint", "last_name varchar", "first_name varchar", "email varchar"]}
