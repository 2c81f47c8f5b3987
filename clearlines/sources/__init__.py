"""Reading and writing pairs, predictions and reports."""
