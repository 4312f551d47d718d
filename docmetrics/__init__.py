"""docmetrics: Spark operators for structured extraction from financial documents and the evaluation of what is extracted.

Everything takes and returns DataFrames or Columns.  ``docmetrics.llm`` holds the text and
large-scale data operators and is never imported by the rest of the package.
"""
