"""clipline: media-timeline analytics as PySpark DataFrame operators.

Every operator is a function from DataFrames to a DataFrame.  Tables hold many
videos (``video_id``) or many edit scripts (``script_id``) at once.
"""
