"""tessaria.streaming"""
