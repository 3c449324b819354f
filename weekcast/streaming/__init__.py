from weekcast.streaming.weekly import (current_weekly_sales, start_weekly_sales,
                                       weekly_sales_stream)

__all__ = ["current_weekly_sales", "start_weekly_sales", "weekly_sales_stream"]
