import pytest


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from wardline.session import ship_package

    ship_package(spark)
