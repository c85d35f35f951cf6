"""garimpo: document-entity analytics and training-data preparation on Spark.

Everything is a function from DataFrame to DataFrame (or Column to Column);
nothing here starts a session or runs an action unless its docstring says so.
"""

__version__ = "0.1.0"
