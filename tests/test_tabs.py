from tillroll.operators.holidays import default_calendar
from tillroll.plans.tabs import SalesTabs

SF = "/root/testdata/sf0.001"


def test_every_tab_runs(spark, lines):
    tabs = SalesTabs(lines, default_calendar(spark))
    views = {}
    views.update(tabs.mtd_overview(year="1996", brand="BUILDING"))
    views.update(tabs.outlet_comparison("NATION_7"))
    views.update(tabs.service_analysis(year="1997", business_unit="AUTOMOBILE"))
    views.update(tabs.growth_analysis("NATION_7"))
    views.update(tabs.holidays_analysis("New Year"))
    chosen_years = tabs.holidays_analysis("New Year", years=[1996, 1997])["holiday_sales"]
    assert len(views) >= 25
    for name, df in views.items():
        df.limit(5).collect()      # every view plans and runs
    assert views["kpis"].count() == 1
    daily = views["daily"].collect()
    assert daily and {r.festival for r in daily} == {"New Year"}
    assert {r.year for r in chosen_years.collect()} <= {1996, 1997}
