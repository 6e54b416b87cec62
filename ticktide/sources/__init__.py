"""Where bars, dimensions and calendars come from and go to."""
