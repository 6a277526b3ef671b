"""tessaria.functions"""
